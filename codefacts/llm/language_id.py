"""Language identification by cross-parsing.

A suffix automaton of each language's labelled text gives longest-match lengths: a text is parsed
greedily into the longest phrases that the labelled text holds, and the language needing the
fewest phrases, normalised, wins. A phrase costs log2 of the size of the labelled text it points
into, so the measure is a cross-entropy in bits per character.

Texts are lower-cased; a letter is a symbol, a run of other characters is one space. Documents are
parsed in segments of ``SEGMENT`` symbols, a new phrase at each start, so that a very long text is
many lanes of one array operation; all segments of the whole text count.

The automata come from a bounded sample of the labelled rows: ``train_docs`` rows per language and
``train_symbols`` symbols of them at most, whatever the size of the input. Everything else covers
all rows. Of a long text a piece at a place that a hash of it fixes is drawn. Every letter of the labelled text has a code: the most frequent ones have a column each in
a table of moves, the others' moves, which are few a state, are looked up.

Defined cases: a null text, one without letters, or a model without languages gives ``und`` and
score 0; a tie goes to the language first in code point order; letters that no language knows are
phrases of their own; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, tidied, unit

#: Symbols of a segment.
SEGMENT = 512
UNDETERMINED = "und"
_OTHER, _SPACE = 1, 0
#: Code points, and bits that hold any code.
_POINTS, _CODE_BITS = 0x110000, 21


@dataclass
class Model:
    languages: list[str]
    #: Code of each code point: 0 no letter, 1 a letter that no automaton knows.
    codes: np.ndarray
    #: Row starts of the automata's states in ``moves``, plus the code, give the next row start;
    #: the sign bit marks that a phrase begins.
    moves: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    #: Codes from here on have no column in ``moves`` but, if a state moves by them, its row start
    #: and the code in ``rare_keys``, sorted, and what ``moves`` would have in ``rare_moves``.
    width: int
    rare_keys: np.ndarray
    rare_moves: np.ndarray


def symbols(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in one array, and how many each has."""
    parts = []
    for t in texts:
        u = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = codes[u]
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != _SPACE) | (c[:-1] != _SPACE)
        parts.append(c[keep])
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts


def automaton(seq: np.ndarray) -> list[dict[int, int]]:
    """The moves of the suffix automaton of a sequence of symbols, by state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


def own_lines(part: list[str], texts: dict[str, list[str]]) -> list[str]:
    """The lines of ``part`` that no second labelled text holds: notices and passages that
    documents share say little of their language. If that leaves nothing, all of them."""
    seen = Counter(line for other in texts.values() for t in other for line in set(t.split("\n")))
    return [line for t in part for line in t.split("\n") if seen[line] == 1] or part


def fit(texts: dict[str, list[str]], train_symbols: int, alphabet: int = 126) -> Model:
    """A model of labelled texts; ``alphabet`` letters at most, the most frequent ones, get columns."""
    codes = np.fromiter(map(str.isalpha, map(chr, range(_POINTS))), dtype=bool, count=_POINTS).astype(np.int32)  # _OTHER
    count: Counter[str] = Counter()
    for part in texts.values():
        for t in part:
            count.update(t.lower())
    seen = [i for _, i in sorted((-n, ord(c)) for c, n in count.items() if c.isalpha())]
    codes[seen] = np.arange(2, 2 + len(seen))
    width = 2 + min(alphabet, len(seen))
    languages, tables, roots, bits, base = [], [], [], [], 0
    rare: list[tuple[int, int]] = []
    texts = {name: own_lines(part, texts) for name, part in texts.items()}
    for name in sorted(texts):
        seq, _ = symbols(texts[name], codes)
        seq = seq[:train_symbols]
        if not (seq > _OTHER).any():
            continue
        table = automaton(seq)
        rows = np.full((len(table), width), base, dtype=np.int64)  # no match: back to the root
        root = rows[0]
        for c, to in table[0].items():
            if c < width:
                root[c] = base + to * width
            else:
                rare.append((base << _CODE_BITS | c, base + to * width | 1 << 31))
        root[_OTHER] = base
        rows[:] = root
        rows |= 1 << 31
        for s, own in enumerate(table):
            if s and own:
                few = {c: to for c, to in own.items() if c < width}
                rows[s, list(few)] = [base + to * width for to in few.values()]
                rare += [((base + s * width) << _CODE_BITS | c, base + to * width) for c, to in own.items() if c >= width]
        rows[:, _OTHER] = base | 1 << 31
        tables.append(rows.astype(np.uint32).ravel())
        languages.append(name)
        roots.append(base)
        bits.append(np.log2(max(2, len(seq))))
        base += rows.size
    if base >= 1 << 31:
        raise ValueError("the model is too large; lower train_symbols")
    moves = np.concatenate(tables) if tables else np.zeros(0, np.uint32)
    keys, to = (np.array([x[k] for x in sorted(rare)], dtype) for k, dtype in ((0, np.int64), (1, np.uint32)))
    small = np.uint8 if len(seen) < 254 else np.uint16 if len(seen) < 65534 else np.int32
    return Model(languages, codes.astype(small), moves, np.array(roots, np.uint32), np.array(bits), width, keys, to)


def rare_moves(model: Model, state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What ``moves`` would have for letters without a column: a state's own move, or else its
    language's first state's, or else none (row by language)."""
    base = np.broadcast_to(model.roots[:, None], state.shape)
    got = base | np.uint32(1 << 31)
    if not len(model.rare_keys):
        return got
    for at in (base, state):
        key = at.astype(np.int64) << _CODE_BITS | code.astype(np.int64)
        k = np.minimum(np.searchsorted(model.rare_keys, key), len(model.rare_keys) - 1)
        got = np.where(model.rare_keys[k] == key, model.rare_moves[k], got)
    return got


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases by text and language; symbols of each text; whether it has a letter."""
    seq, counts = symbols(texts, model.codes)
    letters = np.add.reduceat(np.append(seq != _SPACE, False), np.concatenate(([0], np.cumsum(counts)[:-1]))) if len(texts) else counts
    letters = np.where(counts > 0, letters, 0) > 0
    parts = (counts + SEGMENT - 1) // SEGMENT
    owner = np.repeat(np.arange(len(texts)), parts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(np.cumsum(counts) - counts, parts) + at * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(counts, parts) - at * SEGMENT)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    found = np.zeros((len(model.languages), len(owner)), dtype=np.uint32)
    state = np.repeat(model.roots[:, None], len(owner), axis=1)
    alive = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # lanes with more than k symbols
    low = np.uint32(0x7FFFFFFF)
    for k in range(SEGMENT if len(owner) else 0):
        n = alive[k]
        if not n:
            break
        code = seq[start[:n] + k].astype(np.uint32)
        rare = np.flatnonzero(code >= model.width)
        got = model.moves[state[:, :n] + np.where(code < model.width, code, np.uint32(_OTHER))]
        if len(rare):
            got[:, rare] = rare_moves(model, state[:, rare], code[rare])
        found[:, :n] += got >> np.uint32(31)
        state[:, :n] = got & low
    total = np.zeros((len(texts), len(model.languages)))
    for j in range(len(model.languages)):
        total[:, j] = np.bincount(owner, weights=found[j], minlength=len(texts))
    return total, counts, letters


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is 1 less the ratio of the winner's
    cross-entropy to the runner-up's; 1 if there is but one language."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.languages or not texts:
        return names, scores
    total, _, letters = phrases(model, [t or "" for t in texts])
    cost = total * model.bits
    best = cost.argmin(axis=1)
    if len(model.languages) == 1:
        margin = np.ones(len(texts))
    else:
        two = np.partition(cost, 1, axis=1)
        margin = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
    for i in np.flatnonzero(letters).tolist():
        names[i], scores[i] = model.languages[best[i]], min(1.0, max(0.0, float(margin[i])))
    return names, scores


def sample(docs: DataFrame, train_docs: int, train_symbols: int, seed: int = 7) -> dict[str, list[str]]:
    """Texts by language, ``train_docs`` rows a language at most, fixed by the ids and the seed.

    Counts by language (pre-aggregated) give the share to draw, so no task sees a language's rows
    all together; of a text at most ``4 * train_symbols / train_docs`` characters are taken, from a
    place that its hash fixes, so that how texts begin is not learned alone.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    n = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not n:
        return {}
    share = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, 3 * train_docs / k))])
    drawn = unit("doc_id", F.xxhash64("text"), seed=seed)
    piece = max(1, 4 * train_symbols // train_docs)
    at = F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.lit(1), F.char_length("text") - piece + 1)).cast("int") + 1
    rows = (
        usable.withColumn("u", drawn)
        .where(F.col("u") < share[F.col("lang")])
        .groupBy("lang")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("u", F.substr("text", at, F.lit(piece)).alias("t")))), 1, train_docs).alias("x"))
        .collect()
    )
    return {r["lang"]: [x["t"] for x in r["x"]] for r in rows}


def held_out(doc_id: Column | str) -> Column:
    """The rows that a model may not learn from; a row without an id is none of them."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, train_docs: int = 200, train_symbols: int = 30_000) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    usable = docs.where(~held_out("doc_id"))
    model = fit(sample(usable, train_docs, train_symbols), train_symbols)
    give_back()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, names, scores = part.tolist(), [], []
            at, size = 0, 0
            for i, t in enumerate(texts):  # some MB of text at a time
                size += len(t or "")
                if size > 1_000_000 or i + 1 == len(texts):
                    a, b = predict(shared.value, texts[at : i + 1])
                    names += a
                    scores.append(b)
                    at, size = i + 1, 0
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})

    # Marked so that a filter on the prediction does not run the model a second time.
    got = F.pandas_udf(tidied(run), "lang_pred string, score double").asNondeterministic()(F.col("text"))
    return docs.withColumn("__got", got).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], "__got.lang_pred", "__got.score"
    )
