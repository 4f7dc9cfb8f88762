"""Gates and decisions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.scalar import base64_hex, comparable_etag, host

# Languages and channels that requests may name.
LANGUAGES = ("en", "hi", "ta", "bn", "te", "ml", "kn", "mr", "gu")
CHANNELS = ("web", "sms", "voice")
# Topics that are refused, the first that matches counting, and the thresholds of the gates.
MEDICAL = r"(?i)\b(medic(al|ine|ation)|prescrib|diagnos|symptom|treatment|clinic)\b"
LEGAL = r"(?i)\b(attorney|sue|lawsuit|contract|custody|divorce|legal advice|crime|sentence)\b"
ASR_LEAST, SIMILARITY_LEAST = 0.25, 0.25
# What a document link says, what its path holds, extensions that are fetched, topics worth following, what no answer may hold.
DOCUMENT_WORDS = "download|pdf|guideline|application|form|gazette|notification|circular"
DOCUMENT_PATHS = "/documents/|/uploads/|/files/|/pdf|/download|attachment"
EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "csv", "zip")
TOPICS = "scheme|eligibility|apply|how to|guidelines|notice"
FORBIDDEN = r"(?i)http://|https://|www\.|file://"


def request_error(language: Column, channel: Column, query: Column, asr: Column) -> Column:
    """The first fault of a canonical request, or null."""
    return (
        F.when(F.coalesce(~language.isin(*LANGUAGES), F.lit(True)), "invalid_language")
        .when(F.coalesce(~channel.isin(*CHANNELS), F.lit(True)), "invalid_channel")
        .when(F.coalesce(query, F.lit("")) == "", "empty_query")
        .when((channel == "voice") & asr.isNull(), "missing_asr_confidence")
    )


def blocked_intent(query: Column) -> Column:
    return F.when(query.rlike("(?U)" + MEDICAL), "refusal_medical").when(query.rlike("(?U)" + LEGAL), "refusal_legal")


def asr_refusal(channel: Column, asr: Column) -> Column:
    return F.when((channel == "voice") & (asr < ASR_LEAST), "refusal_asr_low_confidence")


def enough_evidence(n_passages: Column, top: Column) -> Column:
    return (n_passages > 0) & (top >= SIMILARITY_LEAST)


def allowed_domain(url: Column, allowed: tuple[str, ...]) -> Column:
    """The host ends with an entry; without entries all are allowed."""
    out = F.lit(not allowed)
    for entry in allowed:
        out = out | host(url).endswith(entry)
    return F.coalesce(out, F.lit(False))


def implies_document(href: Column, text: Column) -> Column:
    href = F.lower(F.coalesce(href, F.lit("")))
    return F.lower(F.coalesce(text, F.lit(""))).rlike(DOCUMENT_WORDS) | href.rlike(DOCUMENT_PATHS) | href.rlike(rf"\.({'|'.join(EXTENSIONS)})$")


def topical(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(TOPICS)


def prioritized(url: Column) -> Column:
    url = F.lower(url)
    return url.rlike(rf"\.({'|'.join(EXTENSIONS)})$") | url.rlike("/documents/|/uploads/|/files/|file=")


def forbidden_text(text: Column) -> Column:
    return text.rlike(FORBIDDEN)


def sniffed_format(content: Column) -> Column:
    """pdf, html or images from the first 4096 bytes; null if none of them."""
    head = F.lower(F.hex(F.substring(content, 1, 4096)))
    low = F.lower(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"))
    html = low.contains("<html") | low.contains("<!doctype") | low.contains("<body") | low.contains("<div")
    images = head.startswith("ffd8") | low.startswith("\x89png") | (low.startswith("riff") & low.contains("webp")) | low.startswith("ii") | low.startswith("mm")
    return F.when(low.startswith("%pdf"), "pdf").when(low.contains("\x00") & ~low.contains("<html"), None).when(html, "html").when(images, "images")


def file_format(key: Column, content: Column) -> Column:
    """By extension, else by content, else html for pages without one; otherwise unsupported."""
    name = F.regexp_extract(F.regexp_replace(key, "[?#].*$", ""), "([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))
    by_ext = F.when(ext == "pdf", "pdf").when(ext.isin("html", "htm"), "html").when(ext.isin("jpg", "jpeg", "png", "webp", "tif", "tiff"), "images")
    return F.coalesce(by_ext, sniffed_format(content), F.when(ext.isin("", "php"), "html"), F.lit("unsupported"))


def manifest_fault(file_hash: Column, mime_ext: Column, original_url: Column, timestamp: Column) -> Column:
    return (
        F.when(file_hash.isNull() | mime_ext.isNull() | original_url.isNull() | timestamp.isNull(), "missing_fields")
        .when(F.length(file_hash) < 8, "invalid_file_hash")
        .when(F.try_to_timestamp(timestamp).isNull(), "invalid_timestamp")
    )


def change(prior_etag: Column, etag: Column, prior_modified: Column, modified: Column, prior_sha: Column, sha: Column, status: Column) -> Column:
    """Why a fetched page counts as unchanged, or changed, or new."""
    return (
        F.when(prior_sha.isNull(), "new")
        .when(status == 304, "not_modified")
        .when(prior_etag == etag, "etag_match")
        .when(prior_modified == modified, "last_modified_match")
        .when(prior_sha == sha, "sha_match")
        .otherwise("changed")
    )


def transfer(remote: Column, sha: Column, md5: Column, size: Column) -> Column:
    """Why an object counts as present at the other side: remote is null or struct(sha256, content_md5, etag, size). Reasons that begin with match_ skip the transfer."""
    etag = comparable_etag(remote["etag"])
    return (
        F.when(remote.isNull(), "remote_missing")
        .when(F.coalesce(remote["sha256"], F.lit("")) != "", F.when(remote["sha256"] == sha, "match_metadata_sha256").otherwise("metadata_sha256_mismatch"))
        .when(F.coalesce(remote["content_md5"], F.lit("")) != "", F.when(remote["content_md5"] == md5, "match_content_md5_hex").when(base64_hex(remote["content_md5"]) == md5, "match_content_md5_base64").otherwise("content_md5_mismatch"))
        .when((size == remote["size"]) & etag.rlike("^[0-9a-f]{32}$"), F.when(etag == md5, "match_etag_md5").otherwise("etag_mismatch"))
        .otherwise("no_reliable_remote_checksum")
    )
