"""Toxicity by compression distance, with one zstandard dictionary per class.

A toxic text is ordinary but for some of its words: a dictionary of whole toxic
texts is one of ordinary words for the most part, and tells little. So the toxic
dictionary is trained on the spans of toxic texts that ordinary texts all but
lack: the pieces (character sequences of a word) found in a far greater share of
toxic texts. The ordinary dictionary is trained on the words of ordinary texts.
The toxic dictionary goes in front of the ordinary one and padding of its size
takes its place in the other, so that a window without toxic spans costs the
same under both. A window of two words is compressed behind a fixed carrier that
both dictionaries hold: without it, zstandard would store short windows as they
are. A text's largest differences of window lengths, how many windows reach each
threshold, and how many windows it has give its score by a logistic regression.
Regression and thresholds come from texts that the dictionaries at hand have not
seen.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import lean
from loamline.llm.labelled import SAMPLE_ROWS, Logistic, fold, sample

#: Words per window, of which there is one at each word; bytes of the toxic dictionary's own part (the ordinary part has twice as many); zstandard's level.
WINDOW, OWN_BYTES, LEVEL = 2, 8192, 3
#: A longer run of bytes without a space counts as several words.
WORD_BYTES = 64
#: Lengths of pieces; the least number and share of toxic texts that hold one; how many times as frequent it must be there.
PIECES, LEAST, SHARE, RATIO = (5, 6, 7), 5, 0.015, 20
#: The trainer's segments and the pieces that it counts, in bytes.
SEGMENT, PIECE = 50, 8
#: Stands at the end of either dictionary and before every window. Its bytes occur nowhere else, so that both always match it in the same way.
CARRIER = hashlib.sha512(b"carrier").digest()
#: Thresholds: the least difference that at most this share of the ordinary windows reaches, out of fold.
RARE = (1e-2, 1e-3, 1e-4)
#: The regression's ridge penalty; the score at which a text counts as toxic, and the share of ordinary texts that may reach it out of fold.
RIDGE, DECIDED, ORDINARY = 10.0, 0.7, 0.002
#: Words of texts that are looked at together, and windows that are compressed in one call.
TOGETHER, CALL = 20_000, 5_000


_SPACED = bytes(32 if chr(c) in string.punctuation else c for c in range(256))


def _words(text: str) -> list[bytes]:
    """In lower case, cut at white space and ASCII punctuation, and after WORD_BYTES bytes."""
    words = text.lower().encode().translate(_SPACED).split()
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]


def _pieces(word: bytes) -> list[bytes]:
    """The character sequences of some lengths within a word and its two spaces, and all of it."""
    w = b" " + word + b" "
    return [*(w[i : i + k] for k in PIECES if k < len(w) for i in range(len(w) - k + 1)), w]


class Spans:
    """Spans as numbers: most repeat, and the driver holds each once."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = array("i")

    def add(self, spans: Iterable[bytes]) -> None:
        number = self.number
        self.held.extend(number.setdefault(s, len(number)) for s in spans)

    def dictionary(self, size: int, draw: Callable[[int], np.ndarray]) -> bytes:
        """Trained by zstandard on the spans in random order where they suffice for it, else the most frequent spans themselves."""
        import zstandard

        names, drawn = list(self.number), np.frombuffer(self.held, np.int32) if self.held else np.empty(0, np.int32)
        drawn = drawn[draw(len(drawn))]
        groups = [b"".join([names[i] for i in drawn[k : k + 8].tolist()]) for k in range(0, len(drawn), 8)]
        try:
            body = zstandard.train_dictionary(size, groups, k=SEGMENT, d=PIECE).as_bytes()
        except zstandard.ZstdError:
            most = np.argsort(-np.bincount(drawn, minlength=len(names)), kind="stable")[: size // 8]
            body = b"".join(names[i] for i in most[::-1].tolist())
        return body[-size:].rjust(size, b"\0")


@dataclass
class Dictionaries:
    toxic: bytes
    ordinary: bytes

    def compressors(self):
        import zstandard

        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False)
        return make(self.ordinary), make(self.toxic)


#: A training text: its words joined by spaces, and whether it is toxic.
Text = tuple[bytes, int]


def _different(texts: list[Text]) -> list[Text]:
    """One text of those that share the least hash of their five-word shingles under any of three hashes: near copies would make every rare word of a text look telling."""
    seen, out = set(), []
    for text, y in texts:
        words = text.split()
        h = np.fromiter((zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), np.uint64)
        least = [(k, int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 2654435761, 2246822519))]
        if not any(x in seen for x in least):
            out.append((text, y))
        seen.update(least)
    return out


def _counts(texts: list[Text], folds: int) -> list[tuple[Counter, Counter]]:
    """For each fold (every folds-th text): in how many ordinary and toxic texts each piece occurs. Only pieces of LEAST toxic texts or more are counted."""
    toxic: Counter = Counter()
    for text, y in texts:
        if y:
            toxic.update({p for w in set(text.split()) for p in _pieces(w)})
    worth = {p for p, c in toxic.items() if c >= LEAST}
    del toxic
    out = [(Counter(), Counter()) for _ in range(folds)]
    of_word: dict[bytes, tuple] = {}
    for i, (text, y) in enumerate(texts):
        found: set[bytes] = set()
        for w in set(text.split()):
            if w not in of_word:
                of_word[w] = tuple(worth.intersection(_pieces(w)))
            found.update(of_word[w])
        out[i % folds][y].update(found)
    return out


def _sum(parts: list[tuple[Counter, Counter]]) -> tuple[Counter, Counter]:
    return sum((p[0] for p in parts), Counter()), sum((p[1] for p in parts), Counter())


def train_dictionaries(texts: list[Text], count: tuple[Counter, Counter], seed: int = 1) -> Dictionaries:
    """texts, of which none is a near copy of another (see _different), and the counts of their pieces."""
    n = [max(1, sum(y == k for _, y in texts)) for k in (0, 1)]
    need = max(LEAST, SHARE * n[1])
    telling = {p for p, c in count[1].items() if c >= need and c / n[1] > RATIO * (count[0][p] + 0.5) / n[0]}
    spans, ordinary = Spans(), Spans()
    for text, y in texts:
        if not y:
            ordinary.add(b" " + w + b" " for w in text.split())
            continue
        for word in text.split():
            if not telling.isdisjoint(_pieces(word)):
                w = b" " + word + b" "
                covered = bytearray(len(w))
                for k in (*PIECES, len(w)):
                    for i in range(len(w) - k + 1):
                        if w[i : i + k] in telling:
                            covered[i : i + k] = b"1" * k
                spans.add(w[m.start() : m.end()] for m in re.finditer(b"1+", bytes(covered)))
    draw = np.random.default_rng(seed).permutation
    own, common = spans.dictionary(OWN_BYTES, draw), ordinary.dictionary(2 * OWN_BYTES, draw)
    return Dictionaries(own + common + CARRIER, bytes(OWN_BYTES) + common + CARRIER)


def windows(words: list[bytes]) -> list[bytes]:
    """Of a text with fewer words than a window has, all of it."""
    return list(map(b" ".join, zip(*(words[k:] for k in range(WINDOW))))) or [b" ".join(words)]


class Differences:
    """The bytes that the toxic dictionary saves on each window of a text, the greatest first. Windows that repeat in texts looked at together are compressed once; few more would be known from texts before, which isn't worth a memory."""

    def __init__(self, d: Dictionaries) -> None:
        self.ordinary, self.toxic = d.compressors()

    def _learn(self, new: list[bytes]) -> dict[bytes, int]:
        from zstandard import BufferWithSegments

        found: dict[bytes, int] = {}
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            # One buffer, in which a window's carrier follows the window before: no object is made for each.
            place = np.empty((len(part), 2), np.uint64)
            place[:, 1] = np.fromiter(map(len, part), np.uint64, len(part)) + np.uint64(len(CARRIER) + 2)
            place[:, 0] = np.cumsum(place[:, 1]) - place[:, 1]
            whole = BufferWithSegments(CARRIER + b" " + (b" " + CARRIER + b" ").join(part) + b" ", place.tobytes())
            ordinary, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(whole)), np.int64, len(part)) for c in (self.ordinary, self.toxic))
            found.update(zip(part, (ordinary - toxic).tolist()))
        return found

    def __call__(self, texts: Iterable[list[bytes]]) -> Iterator[np.ndarray]:
        some, size = [], 0
        for words in texts:
            some.append(windows(words))
            size += len(words)
            if size > TOGETHER:
                yield from self._of(some)
                some, size = [], 0
        yield from self._of(some)

    def _of(self, some: list[list[bytes]]) -> Iterator[np.ndarray]:
        found = self._learn(list(set().union(*some)))
        for w in some:
            yield -np.sort(-np.fromiter(map(found.__getitem__, w), float, len(w)))


def features(d: np.ndarray, thresholds: tuple[float, ...]) -> list[float]:
    return [d[0], d[:2].mean(), d[:4].mean(), d[:8].mean(), *(np.log1p((d >= t).sum()) for t in thresholds), np.log(len(d))]


@dataclass
class ToxicityModel:
    dictionaries: Dictionaries | None
    logistic: Logistic | None
    thresholds: tuple[float, ...] = ()

    def scorer(self):
        """From texts to scores."""
        if self.logistic is None:
            return lambda texts: [0.0] * len(texts)
        found = Differences(self.dictionaries)
        return lambda texts: self.logistic(np.array([features(d, self.thresholds) for d in found(map(_words, texts))]).reshape(len(texts), -1)).tolist()


def fit(rows: list[tuple[str, int]], folds: int = 3) -> ToxicityModel:
    """rows: (text, toxic). Thresholds and regression see each text under dictionaries trained without its fold; the dictionaries that stay are trained on all. Without toxic or without ordinary rows every score is 0."""
    texts = _different([(b" ".join(_words(t)), y) for t, y in rows])
    y = np.array([y for _, y in texts])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, None)
    parts = _counts(texts, folds)
    found: list[np.ndarray] = [np.empty(0)] * len(texts)
    for k in range(folds):
        rest = [t for i, t in enumerate(texts) if i % folds != k]
        difference = Differences(train_dictionaries(rest, _sum(parts[:k] + parts[k + 1 :])))
        found[k::folds] = difference(t.split() for t, _ in texts[k::folds])
    usual = np.sort(np.concatenate([d for d, toxic in zip(found, y) if not toxic]))
    thresholds = tuple(float(usual[-1 - int(share * len(usual))]) + 1 for share in RARE)
    x = np.array([features(d, thresholds) for d in found])
    logistic = Logistic(x, y, ridge=RIDGE)
    # The decision's own threshold: where few ordinary texts come near it, scores are raised until just so many do. Of too few texts the rarest says nothing.
    p = np.sort(np.log(1 / logistic(x[y == 0]) - 1))
    if ORDINARY * len(p) > 0.2:
        logistic.w[-1] += max(0.0, p[int(ORDINARY * len(p))] - np.log(1 / DECIDED - 1))
    return ToxicityModel(train_dictionaries(texts, _sum(parts)), logistic, thresholds)


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            scores = score(b.column("loamline_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "loamline_score"])

    return run


def with_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with a column loamline_score. Null texts count as empty."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "loamline_score double"])
    return docs.withColumn("loamline_text", F.coalesce(text_col, F.lit(""))).mapInArrow(lean(_scored(model)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Learns from at most sample_rows rows of labels (doc_id, toxic) that are not
    held out; only texts are inputs of a score. Null counts as empty, and an
    empty text is one empty window. Repeated rows get equal scores; an empty
    table gives no rows; without labels of both kinds all scores are 0. Other
    columns are ignored.
    """
    model = fit(sample(docs, labels, "toxic", sample_rows))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = src.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("loamline_text"))
    scored = slim.mapInArrow(_scored(model), "doc_id long, held_out boolean, loamline_score double")
    return scored.select("doc_id", "held_out", F.col("loamline_score").alias("score"), (F.col("loamline_score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns. Nulls, repeated rows and empty tables are as in toxicity()."""
    return with_score(docs, fit(sample(docs, labels, "toxic", sample_rows))).where(F.col("loamline_score") < threshold).drop("loamline_score")
