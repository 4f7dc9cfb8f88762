"""Personal data: exact patterns, and identifiers learnt from the contexts of those.

The base patterns give seed entities; strings in the formats that keys and tokens
are issued in are seeds of a fifth kind, `secret`, but unsure ones. The words
around a seed are its lexical patterns; patterns and the identifiers found in
them form a bipartite graph. Round by round Spark scores each pattern by how many
distinct identifiers of one kind it holds against those of other kinds and
unknown ones, and each unsure or unknown identifier by the patterns that hold it;
identifiers beyond the threshold become seeds of the next round. Occurrences of
learnt identifiers are added to the base spans, which always stay. So a secret is
reported only where patterns speak for it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4

# The base patterns, written so that each text is read in linear time. An e-mail's local part is read leftwards from its @; an address of numbers starts where a run of digits does, as a start within the run leads to the same rest.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 or not p[:-3].strip("0") for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- candidates

_TOKEN = re.compile(r"[^\s|,;\"'<>=]{7,}+")
_HINT = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
_NUMBER = re.compile(r"(?<![A-Za-z0-9@._%+-])\(?+[0-9](?:[ ().-]{0,2}+[0-9])*+(?![A-Za-z0-9@_])")
#: What an unknown token may be, by kind.
_SHAPES = {
    0: re.compile(r"[A-Za-z0-9._%+-]+(?:@|\[at\]|\(at\))[A-Za-z0-9.\[\]()-]+", re.I),
    1: re.compile(r"(?:[0-9a-f]{0,4}:){3,7}[0-9a-f]{0,4}", re.I),
    SECRET: re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/.~-]{12,}"),
}
#: Digits of an unknown card or phone number.
_CARD_DIGITS, _PHONE_DIGITS = (12, 19), (7, 15)
# Formats that keys and tokens are issued in.
_ISSUED = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}")


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int | None, int, int, int]]:
    """(kind if it is an unsure seed, kinds as bits, start, end) of tokens and numbers that have the shape of an identifier of some kind and touch no base span, by start."""
    if not _HINT.search(text):
        return
    out = []
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        if not _HINT.search(text, start, end):
            continue
        while end > start and text[end - 1] in ".:!?)&#%*$":
            end -= 1
        kinds = sum((s.fullmatch(text, start, end) is not None) << k for k, s in _SHAPES.items()) if end - start >= 7 else 0
        if kinds:
            out.append((SECRET if _ISSUED.fullmatch(text, start, end) else None, kinds, start, end))
    for m in _NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        kinds = (_CARD_DIGITS[0] <= digits <= _CARD_DIGITS[1]) << 2 | (_PHONE_DIGITS[0] <= digits <= _PHONE_DIGITS[1]) << 3
        if kinds:
            out.append((None, kinds, m.start(), m.end()))
    taken = sorted((a, b) for _, a, b in base)
    ends = list(accumulate((b for _, b in taken), max))
    done = 0
    for kind, kinds, start, end in sorted(out, key=lambda x: (x[2], -x[3])):
        i = bisect_left(taken, (end, 0))  # base spans that begin before its end
        if start >= done and (not i or ends[i - 1] <= start):
            yield kind, kinds, start, end
            done = end


class Contexts:
    """The lexical patterns of places in a text: the two words before, the word before with the word after, the two words after. Words lie between white space, in lower case, each digit as 0; what is attached to the place counts as a word. Of a very long word its digest is taken."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words = [m.span() for m in _WORD.finditer(text)]

    def _word(self, start: int, end: int) -> str:
        w = _DIGIT.sub("0", self.text[start:end].lower())
        return w if len(w) <= 64 else hashlib.sha256(w.encode()).hexdigest()

    def of(self, start: int, end: int) -> list[str]:
        i = bisect_left(self.words, (start, -1))
        left = []
        if i and self.words[i - 1][1] > start:  # begins within a word
            left.append(self._word(self.words[i - 1][0], start))
            i -= 1
        left += [self._word(*self.words[k]) for k in range(i - 1, max(-1, i - 3), -1)]
        j = bisect_left(self.words, (end, -1))
        right = []
        if j and self.words[j - 1][1] > end:
            right.append(self._word(end, self.words[j - 1][1]))
        right += [self._word(*w) for w in self.words[j : j + 2]]
        out = [f"{left[1]} {left[0]} _"] if len(left) > 1 else []
        if left and right:
            out.append(f"{left[0]} _ {right[0]}")
        if len(right) > 1:
            out.append(f"_ {right[0]} {right[1]}")
        return out


_WORD = re.compile(r"\S+")
_FOUND = "part int, row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, kind int, sure boolean, kinds int, start long, end long, identifier string, contexts array<string>"
_FOUND_ARROW = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("kind", pa.int32()), ("sure", pa.bool_()), ("kinds", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("identifier", pa.string()), ("contexts", pa.list_(pa.string()))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of part 0 per document, and of part 1 per base span and candidate."""
    for b in batches:
        rows = []
        for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
            base = base_spans(text)
            said = spelled(base)
            rows.append((0, row, doc_id, *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(said.encode()).hexdigest(), said, None, None, None, None, None, None, None))
            found = [*((k, True, 1 << k, start, end) for k, start, end in base), *((kind, False, kinds, start, end) for kind, kinds, start, end in candidates(text, base))]
            if found:
                around = Contexts(text)
                rows += [(1, row, None, None, None, None, None, None, None, *x, text[x[3] : x[4]].lower(), around.of(x[3], x[4])) for x in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND_ARROW.types)], schema=_FOUND_ARROW)


# ---------------------------------------------------------------- bootstrapping

#: Rounds; distinct identifiers of the kind a pattern must hold; its least confidence; an identifier's least score; how much an unknown identifier counts against a pattern.
ROUNDS, SUPPORT, CONFIDENCE, SCORE, DOUBT = 3, 5, 0.8, 0.9, 0.1


def learn(spans: DataFrame) -> DataFrame:
    """(identifier, kind) learnt from spans (identifier, kind or null, sure, kinds, contexts): identifiers without a kind, or of an unsure one, that patterns speak for. Nulls: a span without contexts teaches nothing; ties between kinds go to the first; repeated spans count once; without spans nothing is learnt."""
    found = spans.select("identifier", F.when(F.col("kind").isNotNull(), F.struct((~F.col("sure")).alias("unsure"), "kind")).alias("seed"), "kinds", F.explode("contexts").alias("pattern"))
    edges = stored(found.groupBy("pattern", "identifier").agg(F.min("seed").alias("seed"), F.bit_or("kinds").alias("kinds")), "pii-edges")
    # An identifier that is a sure seed anywhere is one everywhere.
    labelled = edges.where("seed is not null").groupBy("identifier").agg(F.min("seed").alias("seed")).select("identifier", "seed.kind", (~F.col("seed.unsure")).alias("settled"))
    learnt = None
    for _ in range(ROUNDS):
        seen = edges.select("pattern", "identifier", "kinds").join(labelled, "identifier", "left")
        by_kind = seen.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
        whole = by_kind.groupBy("pattern").agg(F.sum(F.when(F.col("kind").isNull(), DOUBT * F.col("n")).otherwise(F.col("n"))).alias("all"))
        good = by_kind.where((F.col("kind").isNotNull()) & (F.col("n") >= SUPPORT)).join(whole, "pattern").withColumn("confidence", F.col("n") / F.col("all")).where(F.col("confidence") >= CONFIDENCE)
        held = seen.where(~F.coalesce("settled", F.lit(False))).select("pattern", "identifier", "kinds").join(good.select("pattern", "kind", "confidence"), "pattern")
        held = held.where("getbit(kinds, kind) = 1")
        scored = held.groupBy("identifier", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("score"))
        new = scored.where(F.col("score") >= SCORE).groupBy("identifier").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("best"))
        new = stored(new.select("identifier", (-F.col("best.minus")).cast("int").alias("kind")), "pii-learnt")
        learnt = new if learnt is None else learnt.union(new)
        if new.isEmpty():
            break
        labelled = labelled.join(new.select("identifier"), "identifier", "left_anti").union(new.withColumn("settled", F.lit(True)))
    return learnt


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (all), n_spans (of all), n_learnt (of those that are no base spans).

    Null texts count as empty and have no spans. Positions are code points, the
    end exclusive. Repeated rows each give a row; an empty table gives no rows.
    Other columns are ignored.
    """
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(src.mapInArrow(_find, _FOUND), "pii", ("part",))
    spans = found.where("part = 1").select("row", "kind", "sure", "kinds", "start", "end", "identifier", "contexts")
    learnt = learn(spans)
    more = spans.where("not sure").drop("kind").join(learnt, "identifier").select("row", "kind", "start", "end")
    # Only documents with learnt spans are spelled anew; a document's own spans are in one row there.
    every = more.withColumn("learnt", F.lit(1)).union(spans.where("sure").select("row", "kind", "start", "end").join(more.select("row").distinct(), "row", "left_semi").withColumn("learnt", F.lit(0)))
    again = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("all"), F.sum("learnt").alias("n_learnt"))
    again = again.select("row", "n_learnt", F.concat_ws(",", F.transform("all", lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"]))).alias("anew"))
    per_doc = found.where("part = 0").select("row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").join(again, "row", "left")
    n_learnt = F.coalesce("n_learnt", F.lit(0))
    return per_doc.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.coalesce("anew", "spans").alias("spans"), (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + n_learnt).alias("n_spans"), n_learnt.alias("n_learnt"))


def span_rows(found: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end): a row per span of find_personal_data(). A document without spans has none, repeated rows and null ids have theirs."""
    one = F.explode(F.filter(F.split("spans", ","), lambda x: x != ""))
    parts = F.split("span", ":")
    return found.select("doc_id", one.alias("span")).select("doc_id", parts[0].alias("kind"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))
