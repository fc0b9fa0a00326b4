"""Language identification with bit-sliced Bloom filters over character n-grams.

There is one Bloom filter per language. They share hash functions and are stored by position: a
slot holds a bitmask of the languages whose filter has that bit. The bitwise AND of an n-gram's
slots is the set of languages that contain the n-gram. A text's language is the one that
contains most of its n-grams, after the expected false positives of each filter are taken off.

Learning: a bounded sample of labelled documents per language (``per_language`` in expectation,
chosen by a hash) gives the document frequency of every n-gram; an n-gram belongs to a language
if at least ``min_share`` of its sampled documents hold it. The filter has ``SLOTS`` slots of
one mask, sent to every task.

Texts are folded first: letters in lower case, runs of anything else one space.

Defined results: a null text or one without letters is ``und`` with score 0; without any labelled
document everything is ``und``; equal evidence goes to the first language by code point; repeated
rows get the same answer; null ids are kept; bytes that are not UTF-8 are no letters; labels, ids and other columns never influence an
answer.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.llm.text import mix, readable

UNDETERMINED = "und"
GRAMS = (2, 3, 4)
SLOTS = 1 << 20
HASHES = 3
PER_LANGUAGE = 2000
MIN_SHARE = 0.004
# Characters that are looked up together; longer texts are read in parts.
CHUNK_CHARS = 100_000

_SPACE = 32


@cache
def _folding() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for anything but letters."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    table[0] = 0  # marks the end of a text
    return table


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts as code points, each behind a 0 and a space, and the text of each."""
    joined = "".join("\0 " + (t or "").replace("\0", " ") + " " for t in texts)
    codes = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == _SPACE
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    return codes, np.cumsum(codes == 0) - 1


def grams(codes: np.ndarray, owner: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams within texts, and the text of each; without those that lie in the
    first ``known`` codes."""
    wide, found, owners = codes.astype(np.uint64), [], []
    for n in GRAMS:
        if len(wide) < n:
            continue
        value = np.full(len(wide) - n + 1, n, np.uint64)
        whole = np.ones(len(value), bool)
        letter = np.zeros(len(value), bool)
        for j in range(n):
            part = wide[j : j + len(value)]
            value = value * np.uint64(0x10FFFF + 2) + part
            whole &= part != 0
            letter |= part > _SPACE
        whole &= letter
        whole[: max(known - n + 1, 0)] = False
        found.append(mix(value[whole]))
        owners.append(owner[: len(whole)][whole])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def gram_parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``grams`` of texts in parts: of all up to ``CHUNK_CHARS`` together, of longer ones bit by
    bit. A part starts with the last folded codes of the one before it, so that every n-gram is
    counted once, also where parts meet."""
    long = [i for i, t in enumerate(texts) if t is not None and len(t) > CHUNK_CHARS]
    yield grams(*folded([None if i in long else t for i, t in enumerate(texts)] if long else texts))
    for i in long:
        last = np.zeros(0, np.uint32)
        for at in range(0, len(texts[i]), CHUNK_CHARS):
            part = texts[i][at : at + CHUNK_CHARS]
            codes = folded([part])[0][1:]
            # The space at either end goes where the part cuts a word.
            if at and _is_letter(part[0]):
                codes = codes[1:]
            if at + CHUNK_CHARS < len(texts[i]) and _is_letter(part[-1]):
                codes = codes[:-1]
            if len(last) and last[-1] == _SPACE and len(codes) and codes[0] == _SPACE:
                codes = codes[1:]
            codes = np.concatenate([last, codes])
            yield grams(codes, np.full(len(codes), i), len(last))
            last = codes[-(max(GRAMS) - 1) :]


def _is_letter(char: str) -> bool:
    return _folding()[ord(char)] > _SPACE


def _slots(hashes: np.ndarray, i: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes + np.uint64(i) * step) % np.uint64(SLOTS)).astype(np.int64)


class Model(NamedTuple):
    languages: list[str]
    masks: np.ndarray  # SLOTS x bytes of the language mask
    false_positives: np.ndarray  # per language

    def contained(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram a row of bits, one per language."""
        mask = self.masks[_slots(hashes, 0)]
        for i in range(1, HASHES):
            mask = mask & self.masks[_slots(hashes, i)]
        return np.unpackbits(mask, axis=1, bitorder="little")[:, : len(self.languages)]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, counts = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        if not self.languages:
            return [UNDETERMINED] * len(texts), total
        for hashes, of in gram_parts(texts):
            total += np.bincount(of, minlength=len(texts))
            bits = self.contained(hashes)
            for k in range(bits.shape[1]):
                counts[:, k] += np.bincount(of[bits[:, k] > 0], minlength=len(texts))
        rate = self.false_positives[None, :]
        true = np.clip((counts - rate * total[:, None]) / (1 - rate), 0, None)
        best = true.argmax(axis=1)
        score = np.where(total > 0, true.max(axis=1) / np.maximum(total, 1), 0.0)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, total, strict=True)]
        return names, np.clip(score, 0, 1)


def learn(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    min_share: float = MIN_SHARE,
) -> Model:
    """Bloom filters from rows with a language; others are left out.

    The driver gets the n-grams that belong to each language of the bounded sample.
    """
    rows = labelled.select(
        F.col(lang_col).alias("lang"),
        readable(F.col(text_col)).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)).alias("at"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((SLOTS, 1), np.uint8), np.zeros(0))
    limits = labelled.sparkSession.createDataFrame(
        [(x, int((1 << 30) * min(1.0, per_language / sizes[x]))) for x in languages],
        "lang string, limit bigint",
    )
    sample = rows.join(F.broadcast(limits), "lang").filter("at < limit").select("lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1)
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                parts, docs = [np.zeros(0, np.uint64)], 0
                for i in own:
                    held = np.zeros(0, np.uint64)
                    for found, _ in gram_parts([texts[int(i)].as_py()]):
                        held = np.union1d(held, found)
                    parts.append(held)
                    docs += 1
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                # Hash 0 counts the documents.
                gram, n = np.append(gram, np.uint64(0)), np.append(n, docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    counts = (
        sample.mapInArrow(frequencies, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    sampled = {r["lang"]: r["n"] for r in counts.filter("gram = 0").collect()}
    enough = labelled.sparkSession.createDataFrame(
        [(x, max(2.0, min_share * sampled.get(x, 0))) for x in languages], "lang string, least double"
    )
    owned = (
        counts.filter("gram != 0").join(F.broadcast(enough), "lang").filter("n >= least")
        .select("lang", "gram").toPandas()
    )
    masks = np.zeros((SLOTS, (len(languages) + 7) // 8), np.uint8)
    rates = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = owned.loc[owned["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        filled = np.unique(np.concatenate([_slots(own, i) for i in range(HASHES)]))
        masks[filled, k // 8] |= np.uint8(1 << (k % 8))
        rates[k] = (len(filled) / SLOTS) ** HASHES
    return Model(languages, masks, rates)


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns in ``carry`` with ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = [np.zeros(0)]
            held: list[str | None] = []
            chars = 0
            texts = batch.column(at).cast(pa.binary())
            for i, text in enumerate(texts):
                held.append((text.as_py() or b"").decode("utf-8", "replace"))
                chars += len(held[-1]) + 3
                if chars > CHUNK_CHARS or i + 1 == len(texts):
                    found, score = own.decide(held)
                    names += found
                    scores.append(score)
                    held, chars = [], 0
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(carry)],
                    pa.array(names, pa.string()),
                    pa.array(np.concatenate(scores)),
                ],
                names=[*inner, "lang_pred", "score"],
            )

    # Positional names, so that no carried column can clash with the text or the results. A text
    # that is carried anyway is not sent twice.
    inner = [f"c{i}" for i in range(len(carry))]
    columns = [F.col(c).alias(n) for c, n in zip(carry, inner, strict=True)]
    at = len(carry)
    at = len(carry)
    if text_col in carry and docs.schema[text_col].dataType == T.StringType():
        at = carry.index(text_col)
    else:
        columns.append(F.col(text_col).cast("string").alias("t"))
    rows = docs.select(*columns)
    kinds = "".join(f"{n} {t}, " for n, t in rows.dtypes[: len(carry)])
    out = rows.mapInArrow(run, f"{kinds}lang_pred string, score double")
    return out.withColumnsRenamed(dict(zip(inner, carry, strict=True)))
