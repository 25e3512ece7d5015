"""Language identification by cross-parsing entropy.

A suffix automaton of a language's labelled text reads a document from left to right and always takes the
longest match that goes on; where it ends, a new phrase begins. Few phrases mean a small cross entropy:
phrases * log2(training length) / length is an estimate in bits a byte, and the least one wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, pieces, utf8

#: The bounds of the training sample: passages of a language, code points of each, bytes of all languages.
PASSAGES = 64
PASSAGE_CHARS = 800
LANGUAGE_BYTES = 32 << 10
ALL_BYTES = 512 << 10
#: Texts are parsed in stretches of this many bytes side by side, and joined to one parse of the whole text.
STRETCH = 256
SHARPNESS = 8.0

_ALPHA = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[np.r_[0:0x41, 0x5B:0x61, 0x7B:0x80]] = 0x20


def has_letter(text: str | None) -> bool:
    found = _ALPHA.search(text or "")
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes in which every run of ASCII other than letters is one space."""
    out = _FOLD[data]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20)
    return out[keep]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Moves of the automaton that reads exactly the substrings of text; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass
class Model:
    """Tables of all languages in one array: [state, byte class] -> 2 * next state + (1 if a phrase begins)."""

    languages: list[str]
    classes: np.ndarray
    width: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    @staticmethod
    def learn(texts: dict[str, bytes]) -> Model:
        texts = {k: folded(np.frombuffer(b" ".join([t, b""]), np.uint8)).tobytes() for k, t in texts.items() if t}
        languages = sorted(texts)
        seen = sorted(set().union(*map(set, texts.values()))) if texts else []
        # Class 0 fills up a stretch, class 1 is any byte that no training text has.
        classes = np.ones(256, np.int32)
        classes[seen] = np.arange(2, len(seen) + 2)
        width = len(seen) + 2
        tables, roots, base = [], [], 0
        for name in languages:
            moves = suffix_automaton(texts[name])
            own = np.full((len(moves), width), -1, np.int64)
            for s, m in enumerate(moves):
                for c, t in m.items():
                    own[s, classes[c]] = t
            start = np.where(own[0] >= 0, own[0], 0)
            new = own < 0
            new[0] = True
            own = np.where(own < 0, start[None, :], own)
            own = 2 * (own + base) + new
            own[:, 0] = 2 * base
            tables.append(own.astype(np.int32))
            roots.append(base)
            base += len(moves)
        bits = np.log2([max(2, len(texts[k])) for k in languages]) if languages else np.zeros(0)
        return Model(languages, classes, width, np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32), np.array(roots, np.int32), bits)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each whole folded text (rows) by each language (columns).

        Stretches are read side by side, each from a new phrase. Then the parse of the stretch before is read
        on into each one until both begin a phrase at one place: from there they are the same. Where they never
        meet, the parse that came from before holds, and is read on into the next stretch.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        parts = -(-sizes // STRETCH)
        total = int(parts.sum())
        owner = np.repeat(np.arange(len(texts)), parts)
        codes = np.zeros((total, STRETCH), np.int32)
        at = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        row = np.repeat(np.cumsum(parts) - parts, sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes[row + place // STRETCH, place % STRETCH] = self.classes[at]
        codes = np.ascontiguousarray(codes.T)
        state = np.repeat(self.roots[:, None], total, axis=1)
        begins = np.zeros((STRETCH, *state.shape), bool)
        for k in range(STRETCH):
            step = self.table[state * self.width + codes[k]]
            begins[k] = step & 1
            state = step >> 1
        fresh_count, alone, end = begins.sum(axis=0), state, state.copy()
        count = fresh_count.copy()
        inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        language, stretch = (x.ravel() for x in np.meshgrid(np.arange(len(self.languages)), inner, indexing="ij"))
        while len(stretch):
            own, reach = end[language, stretch - 1], alone[language, stretch]
            before = np.zeros(len(stretch), np.int64)
            later = fresh_count[language, stretch]
            open_ = np.arange(len(stretch))
            for k in range(STRETCH):
                step = self.table[own[open_] * self.width + codes[k, stretch[open_]]]
                fresh = begins[k, language[open_], stretch[open_]]
                go = ~(fresh & (step & 1).astype(bool))
                later[open_[go]] -= fresh[go]
                open_, step = open_[go], step[go]
                before[open_] += step & 1
                own[open_] = step >> 1
                if not len(open_):
                    break
            reach[open_] = own[open_]
            count[language, stretch] = before + later
            moved = reach != end[language, stretch]
            end[language, stretch] = reach
            moved &= np.isin(stretch + 1, inner)
            language, stretch = language[moved], stretch[moved] + 1
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, count[k], len(texts))
        return out

    def predict(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and the share of its weight among all."""
        bits = self.phrases(texts) * self.bits / np.maximum(1, [len(t) for t in texts])[:, None]
        best = bits.argmin(axis=1)
        weight = np.exp2(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
        return best, 1 / weight.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(documents: DataFrame) -> dict[str, bytes]:
    """A bounded sample of passages per language from documents that are not held out.

    Languages are counted over all documents; the share of documents looked at follows from the counts,
    about PASSAGES for each language, and each gives one passage, however many rows its id has. What is
    gathered does not grow.
    """
    able = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    able = able.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    counts = {r[0]: r[1] for r in able.groupBy("lang").count().collect()}
    if not counts:
        return {}
    each = min(LANGUAGE_BYTES, ALL_BYTES // len(counts))
    passages = min(4 * PASSAGES, max(8, 2 * PASSAGES * each // LANGUAGE_BYTES))
    limit = F.lit(0)
    for name, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == name, F.lit(int(min(1.0, passages / n) * (1 << 30)))).otherwise(limit)
    start = F.pmod(F.col("draw"), F.greatest(F.lit(1), F.length("text") - PASSAGE_CHARS)).cast("int") + 1
    rows = able.filter(F.col("draw") < limit).select("lang", "draw", "doc_id", F.substring("text", start, F.lit(PASSAGE_CHARS)).alias("passage"))
    rows = rows.groupBy("lang", "draw", "doc_id").agg(F.min("passage").alias("passage"))
    out: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.draw, r.doc_id, r.passage)):
        out[r.lang].append(r.passage.lower().encode())
    return {k: b" ".join(v)[:each] for k, v in out.items()}


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            known = [has_letter(t) and bool(own.languages) for t in texts]
            low = pa.array([t.lower() if k else "" for t, k in zip(texts, known, strict=True)], pa.string())
            data, offsets = utf8(low)
            names, scores = [], []
            for a, b in pieces(offsets, PIECE_BYTES // max(1, len(own.languages) // 4)):
                best, score = own.predict([folded(data[offsets[k] : offsets[k + 1]]) for k in range(a, b)]) if own.languages else (np.zeros(b - a, int), np.zeros(b - a))
                names += [own.languages[x] if k else "und" for x, k in zip(best.tolist(), known[a:b], strict=True)]
                scores += [s if k else 0.0 for s, k in zip(score.tolist(), known[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Learns from text and lang of documents whose crc32(doc_id) mod 4 is not 2, in a sample bounded by the
    constants above; predictions see the whole text alone. Null text and text without a letter are `und`
    with score 0, as is everything if no language can be learned. A null doc_id is not held out and not
    learned from. Repeated rows each have their row. Empty table: no rows. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = documents.sparkSession.sparkContext.broadcast(Model.learn(training_texts(docs)))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
