"""Language identification of mixed-language text.

Each word gets a score for each language: the sum of learned log-probabilities of its byte n-grams, for the
languages that its script leaves as candidates. A Viterbi path over the words, with a penalty for each switch,
labels spans; a text's language is that with the most letters in its spans.

Scores of a whole batch are computed with numpy. The path is one language throughout wherever no stretch of words
gains more in other languages than a switch costs; only other texts need the step-by-step recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.grams import Grams, blocks, byte_classes, per_text
from marlstone.llm.shared import few_by_hash, held_out, lowered
from marlstone.shipping import ship

#: Unicode ranges of scripts, as (first code point, last, script).
SCRIPT_RANGES = (
    (0x0041, 0x005A, "Latin"),
    (0x0061, 0x007A, "Latin"),
    (0x00AA, 0x00AA, "Latin"),
    (0x00BA, 0x00BA, "Latin"),
    (0x00C0, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0531, 0x058F, "Armenian"),
    (0x0591, 0x05F4, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"),
    (0x08A0, 0x08FF, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x309F, "Hiragana"),
    (0x30A0, 0x30FF, "Katakana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
)
_SCRIPTS = sorted({s for *_, s in SCRIPT_RANGES})
_FIRST = np.array([r[0] for r in SCRIPT_RANGES])
_LAST = np.array([r[1] for r in SCRIPT_RANGES])
_BIT = np.array([1 << _SCRIPTS.index(r[2]) for r in SCRIPT_RANGES], dtype=np.uint32)
_LATIN = np.uint32(1 << _SCRIPTS.index("Latin"))
_CLASSES = byte_classes(digits=False)
_LETTER = regex.compile(r"\p{L}")

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    #: The training sample: at most so many ids of a language, in all, and languages; whole texts are learned from.
    per_language: int = 1000
    most_documents: int = 12000
    #: The model has 2 ** bits numbers for each language, and is broadcast; more languages are an error.
    most_languages: int = 64
    sizes: tuple[int, ...] = (2, 3, 4)
    bits: int = 17
    smoothing: float = 0.5
    #: n-grams overlap, so their log-probabilities count this much.
    weight: float = 0.35
    #: Most that one word can say for one language against another.
    word_most: float = 12.0
    switch: float = 10.0
    #: A language is a candidate for a script that has at least this share of its training letters.
    script_share: float = 0.01


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets by languages: log-probabilities, centred
    scripts: np.ndarray  # the scripts of each language, as bits
    settings: Settings = field(default_factory=Settings)


def word_scripts(block: Grams) -> np.ndarray:
    """For each word the scripts of its letters, as bits."""
    a = block.bytes
    out = np.zeros(block.n_words, dtype=np.uint32)
    if not block.n_words:
        return out
    ascii_letter = (a >= 97) & (a <= 122)
    latin = np.add.reduceat(ascii_letter.astype(np.int32), block.starts) > 0
    out[latin] = _LATIN
    lead = np.flatnonzero(a[: len(a) - 3] >= 0xC0)
    if len(lead):
        b0, b1, b2 = (a[lead + k].astype(np.int64) for k in range(3))
        two, three = b0 < 0xE0, b0 < 0xF0
        code = np.where(two, (b0 & 31) << 6 | b1 & 63, np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, 0x10000))
        at = np.maximum(np.searchsorted(_FIRST, code, side="right") - 1, 0)
        bits = np.where((code >= _FIRST[at]) & (code <= _LAST[at]), _BIT[at], np.uint32(0))
        word = np.searchsorted(block.starts, lead, side="right") - 1
        np.bitwise_or.at(out, word, bits)
    return out


def count_grams(texts: list[bytes], settings: Settings) -> np.ndarray:
    """How often each bucket's n-grams occur in texts of one language, and after them words with a letter of each script."""
    out = np.zeros((1 << settings.bits) + len(_SCRIPTS), dtype=np.int64)
    for raw, _ in blocks(texts):
        block = Grams(raw, settings.sizes, settings.bits, _CLASSES)
        for buckets in block.buckets:
            out[: 1 << settings.bits] += np.bincount(buckets, minlength=1 << settings.bits)
        masks = word_scripts(block)
        out[1 << settings.bits :] += [int((masks >> np.uint32(k) & 1).sum()) for k in range(len(_SCRIPTS))]
    return out


def fitted(counts: dict[str, np.ndarray], settings: Settings = Settings()) -> Model:
    """Multinomial log-probabilities of hashed n-grams, by the counts of each language."""
    names = sorted(counts)
    table = np.zeros((1 << settings.bits, max(1, len(names))), dtype=np.float32)
    scripts = np.zeros(max(1, len(names)), dtype=np.uint32)
    for c, name in enumerate(names):
        grams, letters = counts[name][: 1 << settings.bits] + settings.smoothing, counts[name][1 << settings.bits :]
        table[:, c] = (np.log(grams) - np.log(grams.sum())) * settings.weight
        scripts[c] = ((letters / max(letters.sum(), 1) >= settings.script_share) * (1 << np.arange(len(_SCRIPTS)))).sum()
    table -= table.mean(axis=1, keepdims=True)
    return Model(names, table, scripts, settings)


def train(texts: list[bytes], languages: list[str], settings: Settings = Settings()) -> Model:
    """A model of lower-cased UTF-8 texts and their languages."""
    of: dict[str, list[bytes]] = {}
    for text, language in zip(texts, languages):
        of.setdefault(language, []).append(text)
    return fitted({name: count_grams(own, settings) for name, own in of.items()}, settings)


def score_words(model: Model, texts: list[bytes]) -> list[np.ndarray]:
    """For each text an array of (letters, score of each language) by word."""
    s, width = model.settings, len(model.languages)

    def of_block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        block = Grams(raw, s.sizes, s.bits, _CLASSES)
        scores = block.sums(model.table)
        masks = word_scripts(block)
        # A language that lacks all scripts of the word is out, where another one has some.
        fits = (masks[:, None] & model.scripts[None, :]) != 0
        out = ~fits & fits.any(axis=1, keepdims=True)
        scores -= scores.max(axis=1, keepdims=True)
        scores = np.maximum(scores, -s.word_most)
        scores[out] = -s.word_most
        # Letters, not bytes: all but the continuation bytes of UTF-8.
        upto = np.concatenate([[0], np.cumsum((block.bytes & 0xC0) != 0x80)])
        return block.starts - 1, np.column_stack([upto[block.ends] - upto[block.starts], scores])

    return per_text(texts, 1 + width, of_block)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best path of languages through the words' scores, each change of language costing ``switch``."""
    totals = scores.sum(axis=0)
    best = int(totals.argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), dtype=np.int64)
    others = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
    gained = np.concatenate([[0.0], np.cumsum(others)])
    if (gained - np.minimum.accumulate(gained)).max() <= switch:
        return np.full(len(scores), best, dtype=np.int64)
    # A few languages and many words: plain lists are faster than small arrays here.
    rows = scores.tolist()
    value, tops, moved = rows[0], [], []
    for row in rows[1:]:
        most = max(value)
        tops.append(value.index(most))
        most -= switch
        moved.append([x < most for x in value])
        value = [(most if x < most else x) + y for x, y in zip(value, row)]
    path = [value.index(max(value))]
    for top, went in zip(reversed(tops), reversed(moved)):
        path.append(top if went[path[-1]] else path[-1])
    return np.array(path[::-1], dtype=np.int64)


def spans(path: np.ndarray, model: Model) -> list[tuple[str, int, int]]:
    """(language, first word, end word) of the spans of a text's path."""
    if not len(path):
        return []
    cuts = np.flatnonzero(np.diff(path)) + 1
    return [(model.languages[path[a]], int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(path)])]


def judge(words: np.ndarray, path: np.ndarray, model: Model) -> tuple[str, float]:
    """The language with the most letters in its spans, and its share of them, times how sure it is among all."""
    letters = np.bincount(path, weights=words[:, 0], minlength=len(model.languages))
    best = int(letters.argmax())
    own = words[path == best, 1:].sum(axis=0)
    rest = np.delete(own, best)
    sure = 1.0 if not len(rest) else float(1 / (1 + np.exp(np.clip(rest.max() - own[best], -50, 50))))
    return model.languages[best], float(letters[best] / letters.sum()) * sure


def trained(docs: DataFrame, settings: Settings) -> Model:
    """The model of a bounded sample of docs(doc_id, text, lang): ids outside the held-out fold, by a hash, with a language.

    The executors count n-grams of the whole texts; the driver gets a number for each language and bucket.
    """
    named = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = sorted(r[0] for r in named.select("lang").distinct().limit(settings.most_languages + 1).collect())
    if len(names) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages: their model has no bound")
    if not names:
        return fitted({}, settings)
    each = max(1, min(settings.per_language, settings.most_documents // len(names)))
    few = few_by_hash(named.select("doc_id", "lang"), each, "lang", settings.most_languages)
    # At most most_documents ids: a proven bound.
    found = named.select("doc_id", "lang", "text").join(F.broadcast(few), ["doc_id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            of: dict[str, list[bytes]] = {}
            for name, text in zip(batch.column(0).to_pylist(), lowered(batch.column(1))):
                of.setdefault(name, []).append(text)
            for name, texts in of.items():
                sums[name] = sums.get(name, 0) + count_grams(texts, settings)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), names.index(name), np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    ship(docs.sparkSession)
    rows = found.mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (rows[c].to_numpy() for c in ("lang", "bucket", "n"))
    counts = {}
    for c, name in enumerate(names):
        counts[name] = np.zeros((1 << settings.bits) + len(_SCRIPTS), dtype=np.int64)
        counts[name][bucket[lang == c]] = n[lang == c]
    return fitted(counts, settings)


def identify_languages(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_spans: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, and ``with_spans`` spans as an array of (lang, first, end) in words.

    Null texts and texts without a letter get "und" and score 0. Without any training row every text does. Very long
    texts are scored whole, in blocks. Null languages are not learned from; a null id counts as held out. Of
    languages with equally many letters the first by name counts. Repeated rows get repeated results. Other
    columns are ignored; an empty table gives no rows. More than ``most_languages`` languages raise a ValueError.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = trained(named, settings)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = lowered(batch.column(2))
            words = score_words(model, texts) if model.languages else []
            names, scores, parts = [], [], []
            for i, raw in enumerate(texts):
                if not model.languages or not len(words[i]) or not _LETTER.search(raw.decode()):
                    names.append(UNDETERMINED), scores.append(0.0), parts.append([])
                    continue
                path = viterbi(words[i][:, 1:], model.settings.switch)
                name, score = judge(words[i], path, model)
                names.append(name), scores.append(score)
                parts.append([{"lang": x, "first": a, "end": b} for x, a, b in spans(path, model)] if with_spans else [])
            columns = {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_pydict(columns | ({"spans": pa.array(parts, kind)} if with_spans else {}))

    rows = named.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    ship(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double" + ", spans array<struct<lang:string,first:int,end:int>>" * with_spans)
