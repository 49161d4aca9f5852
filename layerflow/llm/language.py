"""Language identification as inference of a mixture of languages.

Letter trigrams within words are counted per language over all documents that
may be learned from. A document is a mixture: each of its words comes from one
language. Expectation-maximisation estimates the proportions from the trigram
likelihoods of the words; the set of languages is the one whose likelihood,
less a penalty per language, is best among the sets of the largest proportions.

Trigrams are counted in ``SLOTS`` hashed slots, so the model that is sent to
the executors has a fixed size per language: 131,072 floats (0.5 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.llm.common import chunks, held_out, in_arrow, mixed, stacked

SLOTS = 1 << 17
SMOOTHING = 0.05  # added to every slot's count
PENALTY = 2.0  # log-likelihood that a further language costs, times log(1 + words)
MOST_LANGUAGES = 512
ROUNDS, CLOSE = 40, 1e-3
UNDETERMINED = "und"

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all other code points."""
    if not _letter:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                small = c.lower()
                table[code] = ord(small) if len(small) == 1 else code
        _letter.append(table)
    return _letter[0]


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each letter's trigram, first position of each word among these,
    and the row of each word."""
    rows = len(bounds) - 1
    text = data.tobytes().decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    if before[-1] != len(code):  # bytes that are not UTF-8
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        before = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    owner = np.repeat(np.arange(rows), np.diff(before))
    spaced = np.zeros(len(code) + rows + 2, np.uint64)
    spaced[np.arange(len(code)) + owner + 1] = _letters()[code]
    at = np.flatnonzero(spaced)
    slot = mixed(
        spaced[at - 1] * np.uint64(0x9E3779B97F4A7C15)
        + spaced[at] * np.uint64(0xC2B2AE3D27D4EB4F)
        + spaced[at + 1] * np.uint64(0x165667B19E3779F9)
    ) >> np.uint64(64 - 17)
    first = np.flatnonzero(spaced[at - 1] == 0)
    start = before[:-1] + np.arange(rows) + 1
    return slot.astype(np.int64), first, np.searchsorted(start, at[first], side="right") - 1


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # slots by languages


_COUNTED = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        name = batch.column(1).to_numpy(zero_copy_only=False)
        for row, end, data, bounds in chunks(batch.column(0)):
            slot, first, owner = trigrams(data, bounds)
            lang = name[row:end][np.repeat(owner, np.diff(np.concatenate([first, [len(slot)]])))]
            for one in set(name[row:end]):
                if one not in found:
                    found[one] = np.zeros(SLOTS, np.int64)
                found[one] += np.bincount(slot[lang == one], minlength=SLOTS)
    for one, n in found.items():
        at = np.flatnonzero(n)
        yield stacked({"lang": [one] * len(at), "slot": at, "n": n[at]}, _COUNTED)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams of all rows with a non-null ``lang``.

    No such rows give a model without languages. More than ``MOST_LANGUAGES``
    labels are refused, as the model's size grows with them.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counted = in_arrow(rows, _count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    labels = [r.lang for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(labels) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(labels)
    counts = np.zeros((SLOTS, len(languages)))
    if languages:
        table = counted.toArrow()
        place = {name: k for k, name in enumerate(languages)}
        column = np.array([place[x] for x in table["lang"].to_pylist()], int)
        counts[table["slot"].to_numpy(), column] = table["n"].to_numpy()
    smooth = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * SLOTS))
    return Model(languages, smooth.astype(np.float32))


def _expectation(ll: np.ndarray, first: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents, by EM until they settle.

    ``ll`` has a row per word and ``first`` the first word of each document;
    ``share`` holds the proportions to start from, 0 for languages left out.
    """
    share = share.copy()
    total = np.zeros(len(first))
    words = np.diff(np.concatenate([first, [len(ll)]]))
    top = ll.max(1, keepdims=True)
    scaled, top = np.exp(ll - top), top[:, 0]
    base = np.add.reduceat(top, first) if len(first) else total
    active = np.arange(len(first))
    for k in range(ROUNDS):
        n = words[active]
        if k and len(active) < len(first):
            inside = np.zeros(len(first), bool)
            inside[active] = True
            part = scaled[np.repeat(inside, words)]
        else:
            part = scaled
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        weight = part * np.repeat(share[active], n, 0) + 1e-300
        whole = weight.sum(1)
        total[active] = np.add.reduceat(np.log(whole), begin) + base[active]
        new = np.add.reduceat(weight / whole[:, None], begin, axis=0) / n[:, None]
        moved = np.abs(new - share[active]).max(1) > CLOSE
        share[active] = new
        active = active[moved]
        if not len(active):
            break
    return share, total


def mixtures(ll: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages for each document (0: left out)."""
    docs, count = len(first), ll.shape[1]
    if count == 1 or not docs:
        return np.ones((docs, count))
    words = np.diff(np.concatenate([first, [len(ll)]]))
    full, reach = _expectation(ll, first, np.full((docs, count), 1 / count))
    order = np.argsort(-full, 1, kind="stable")
    cost = PENALTY * np.log1p(words)
    single = np.add.reduceat(ll, first, axis=0)
    best = single.max(1)
    result = np.zeros((docs, count))
    result[np.arange(docs), single.argmax(1)] = 1
    # No set can gain more than the full one does.
    todo = np.flatnonzero(reach - best > cost)
    size = 2
    while len(todo) and size <= count:
        inside = np.zeros(docs, bool)
        inside[todo] = True
        part = ll[np.repeat(inside, words)]
        begin = np.concatenate([[0], np.cumsum(words[todo])[:-1]])
        start = np.zeros((len(todo), count))
        np.put_along_axis(start, order[todo, :size], 1 / size, 1)
        share, value = _expectation(part, begin, start)
        value = value - (size - 1) * cost[todo]
        better = value > best[todo]
        best[todo[better]], result[todo[better]] = value[better], share[better]
        todo = todo[reach[todo] - size * cost[todo] > best[todo]]
        size += 1
    return result


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score, languages and proportions (names start with ``prefix``).

    lang_pred has the largest proportion (ties: the first name), score is that
    proportion, languages and proportions hold the selected set. Texts that are
    null or have no letter, and all texts where nothing was learned, get
    ``und``, 0 and empty lists. Columns of the same names are replaced.
    """
    added = [prefix + n for n in ("lang_pred", "score", "languages", "proportions")]
    kept = [c for c in docs.columns if c not in added]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_likelihood))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = shared.value
        names = np.array([*languages, UNDETERMINED], object)
        for batch in batches:
            own = [batch.column(k) for k in range(len(kept))]
            for row, end, data, bounds in chunks(batch.column(len(kept))):
                n = end - row
                best, score = np.full(n, len(languages)), np.zeros(n)
                sets: list[list[str]] = [[] for _ in range(n)]
                shares: list[list[float]] = [[] for _ in range(n)]
                slot, first, owner = trigrams(data, bounds)
                if len(first) and languages:
                    ll = np.add.reduceat(table[slot], first, axis=0).astype(float)
                    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    result = mixtures(ll, begin)
                    which = owner[begin]
                    best[which], score[which] = result.argmax(1), result.max(1)
                    for doc, share in zip(which, result, strict=True):
                        used = [k for k in np.argsort(-share, kind="stable") if share[k] > 0]
                        sets[doc], shares[doc] = [languages[k] for k in used], [float(share[k]) for k in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(row, n) for c in own),
                        pa.array(names[best], pa.string()),
                        pa.array(np.minimum(score, 1.0)),
                        pa.array(sets, pa.list_(pa.string())),
                        pa.array(shares, pa.list_(pa.float64())),
                    ],
                    names=[*kept, *added],
                )

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())), strict=True):
        schema = schema.add(name, kind)
    return in_arrow(source, run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ...): learned from the rows that are not held out."""
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` in a determined language of at least this proportion."""
    model = learn(docs.where(~held_out()))
    named = identify(docs, model, prefix="__")
    return named.where((F.col("__lang_pred") != UNDETERMINED) & (F.col("__score") >= least)).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )
