"""Language-model scores of texts: a probabilistic suffix tree, beside plain word frequencies.

A text is lower-cased (A-Z), its words joined by single blanks, and an end symbol added. The tree's symbols are the 256
bytes of that text. Training counts every run of `depth` + 1 symbols of every training text (`depth` is at most 6). A
context of k symbols is a state if it was seen `least` times (N * `share` times, if a share is given) and passes a
divergence test against the context one symbol shorter: n(s) * KL(P(.|s) || P(.|parent)) must reach `nats` for each next
symbol seen, and the KL itself `least_kl`. All contexts that pass are states, at every size of the corpus, with all their
prefixes and suffixes. Next-symbol distributions are smoothed: (n(sx) + beta * P(x|parent)) / (n(s) + beta). A text's score
adds up log10 P(symbol | longest suffix state).

The states are a staged table. At most `dense_states` of them are scored by an automaton; else those seen most often, with
`held_runs` next symbols in all, are written to the shared folder by tasks and read by each worker as sorted keys, and runs
that reach a state beyond them meet theirs in a shuffle join. All three give the same scores.

The base score sums log10((c + 0.1) / (N + 0.1 * (V + 1))) over words and one end, with c a token's training count. Counts
of the words met most often (at most `broadcast_words`) are broadcast; all others meet their counts in a shuffle join.

Defined results: null and empty texts have the end token alone; with no training rows every count is 0 and the tree is
its root, uniform; a null id's fold is null and it is neither held out nor trained on; repeated rows each count and each
get a row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C
from shelfline.llm.warc import open_fs

END = 10  # a line end never stands within a normalised text; a run of them stands before it


def streams(texts: list[bytes], depth: int) -> tuple[bytes, np.ndarray]:
    """All normalised texts, each after `depth` ends and with one behind; and where each one's first symbol stands."""
    pad = b"\n" * depth
    parts = [pad + b" ".join(t.translate(C.LOWER).split()) + b"\n" for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return b"".join(parts), np.cumsum(sizes) - sizes + depth


class _Counter:
    """Sums counts of 64-bit keys in bounded memory."""

    def __init__(self, most: int = 1_500_000):
        self.held, self.size, self.most = [], 0, most

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        k, n = np.unique(keys, return_counts=True)
        self.held.append((k, n.astype(np.int64)))
        self.size += len(k)
        if self.size < self.most:
            return None
        k, n = self.total()
        self.held, self.size = [(k, n)], len(k)
        if self.size < self.most // 2:
            return None
        self.held, self.size = [], 0
        return k, n

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        k, n = np.concatenate([x[0] for x in self.held]), np.concatenate([x[1] for x in self.held])
        if not len(k):
            return k, n
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return k[first], np.add.reduceat(n, first)


def windows(raw: bytes, width: int) -> np.ndarray:
    """For each place of raw, the `width` bytes that end there as a number, the last one lowest; the first width - 1 are void."""
    padded = b"\0" * 7 + raw
    whole = np.ndarray(len(raw), ">u8", padded, strides=(1,)).astype(np.uint64)
    return whole & np.uint64((1 << (8 * width)) - 1)


def training_counts(train: DataFrame, depth: int, text_col: str) -> DataFrame:
    """(kind, key, n): of words (kind 0, by hash), of runs of depth + 1 symbols (1, the last one lowest), and of texts (2)."""

    def batch_of(kind: int, found) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(found[0]), kind, np.int32)), "key": pa.array(found[0].view(np.int64)), "n": pa.array(found[1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, docs = _Counter(), _Counter(), 0
        for batch in batches:
            for _, _, texts in C.text_groups(batch.column(0), 2 << 20):
                docs += len(texts)
                raw, begins = streams(texts, depth)
                buf = np.frombuffer(raw, np.uint8)
                pad = np.zeros(len(buf) + 1, np.int8)
                pad[begins - depth] += 1
                pad[begins] -= 1
                for kind, counter, keys in ((0, words, C.word_hashes(buf, *C.word_bounds(buf, C.SPACED))), (1, grams, windows(raw, depth + 1)[np.cumsum(pad[:-1]) == 0])):
                    if (out := counter.add(keys)) is not None:
                        yield batch_of(kind, out)
        yield batch_of(0, words.total())
        yield batch_of(1, grams.total())
        yield batch_of(2, (np.zeros(1, np.uint64), np.array([docs], np.int64)))

    return train.select(F.col(text_col)).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Tree:
    """Tables of the suffix tree: from a state and a symbol to the next state, and the symbol's log10 probability."""

    def __init__(self, depth: int, letters: np.ndarray, states: list[bytes], counts: dict[bytes, tuple[np.ndarray, np.ndarray]], beta: float):
        """letters: bytes met, with symbols of their own, while the others are alike; states by length; counts: a state's (next byte, n)."""
        self.depth = depth
        self.symbol = np.full(256, len(letters), np.int16)
        self.symbol[letters] = np.arange(len(letters))
        others = 256 - len(letters)
        width = len(letters) + 1
        index = {s: i for i, s in enumerate(states)}
        prob = np.empty((len(states), width))
        self.next = np.zeros((len(states), width), np.int32)
        for i, s in enumerate(states):
            n = np.zeros(width)
            if s in counts:
                np.add.at(n, self.symbol[counts[s][0]], counts[s][1])
            if not s:
                prob[i] = (n + 0.5 * np.append(np.ones(len(letters)), max(1, others))) / (n.sum() + 0.5 * 256)
            else:
                prob[i] = (n + beta * prob[index[s[1:]]]) / (n.sum() + beta)
                self.next[i] = self.next[index[s[1:]]]
            for j, c in enumerate(letters.tolist()):
                if (to := index.get(s + bytes([c]))) is not None:
                    self.next[i, j] = to
        prob[:, -1] /= max(1, others)
        self.log10 = np.log10(prob).astype(np.float32)

    def score(self, raw: bytes, begins: np.ndarray) -> np.ndarray:
        """Sum of log10 probabilities of each stream's symbols from `begins` to its end."""
        buf = self.symbol[np.frombuffer(raw, np.uint8)]
        n, lane = len(buf), 256
        lanes = -(-n // lane)
        whole = np.concatenate((np.full(self.depth, self.symbol[END], np.int16), buf, np.zeros(lanes * lane - n, np.int16)))
        width = self.log10.shape[1]
        to, log10 = self.next.ravel(), self.log10.ravel()
        out = np.empty((lane, lanes), np.float32)
        state = np.zeros(lanes, np.int32)
        start = np.arange(lanes) * lane
        for t in range(self.depth + lane):  # the first steps only find the state
            at = state * width + whole[start + t]
            if t >= self.depth:
                out[t - self.depth] = log10[at]
            state = to[at]
        sums = np.zeros(n + 1)
        np.cumsum(out.T.ravel()[:n], dtype=np.float64, out=sums[1:])
        ends = np.concatenate((begins[1:] - self.depth, [n]))
        return sums[ends] - sums[begins]


class Backoff:
    """States as sorted keys by length: the log10 of next symbols seen, and what all others lose against the parent."""

    def __init__(self, depth: int, root: np.ndarray, levels: list[tuple[np.ndarray, ...]], beyond: list[np.ndarray]):
        """root: each byte's log10; levels: from length 1 (keys, log10, contexts, back); beyond: by length from 0, contexts
        of which a longer one is a state that isn't held here."""
        self.depth, self.root, self.levels, self.beyond = depth, root, levels, beyond

    def values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10, length of the state, whether a longer one may hold) of sorted distinct runs of depth + 1 symbols."""
        chain, ups = [keys], []
        for k in range(self.depth, 0, -1):
            one, up = np.unique(chain[0] & np.uint64((1 << (8 * k)) - 1), return_inverse=True)
            chain.insert(0, one)
            ups.insert(0, up)
        v = self.root[chain[0].astype(np.int64)]
        length, deep = np.zeros(len(v), np.int64), np.full(len(v), len(self.beyond[0]) > 0)
        for k, (own, own_log, contexts, back) in enumerate(self.levels, 1):
            v, length, deep = v[ups[k - 1]], length[ups[k - 1]], deep[ups[k - 1]]
            ctx = chain[k] >> np.uint64(8)
            at, state = _found(contexts, ctx)
            v[state] += back[at[state]]
            at, seen = _found(own, chain[k])
            v[seen] = own_log[at[seen]]
            length[state] = k
            deep[state] = _found(self.beyond[k], ctx[state])[1]
        return v, length, deep

    def score(self, raw: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each stream's sum over runs whose state is held; and the other runs' (keys with the length held above, log10 so
        far, where each stream's begin)."""
        pad = np.zeros(len(raw) + 1, np.int8)
        pad[begins - self.depth] += 1
        pad[begins] -= 1
        inside = np.flatnonzero(np.cumsum(pad[:-1]) == 0)
        back, one = pd.factorize(windows(raw, self.depth + 1)[inside])  # by hash: faster than sorting all places
        order = np.argsort(one)
        one, place = one[order], np.empty_like(order)
        place[order] = np.arange(len(order))
        back = place[back]
        v, length, deep = self.values(one)
        first = np.append(np.searchsorted(inside, begins), len(inside))
        sums = np.concatenate(([0.0], np.cumsum(np.where(deep, 0.0, v)[back])))
        open_, before = deep[back], np.concatenate(([0], np.cumsum(deep[back])))[first]
        keys = one | (length.astype(np.uint64) << np.uint64(56))
        return sums[first[1:]] - sums[first[:-1]], keys[back[open_]], v[back[open_]], before


def _found(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of asked stands in held, and whether it does."""
    if not len(held):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    return at, held[at] == asked


def _low(column: str, symbols) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns after the first, by which rows come sorted, in pieces of about `least` rows that part no equal firsts."""
    held, size, wanted = [], 0, least
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < wanted:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        edge = np.flatnonzero(whole[0][1:] != whole[0][:-1])
        cut = int(edge[-1]) + 1 if len(edge) else 0
        if cut:
            yield [c[:cut] for c in whole[1:]]
        held, size = [[c[cut:] for c in whole]], size - cut
        wanted = max(least, 2 * size)
    if size:
        yield [np.concatenate(c) for c in list(zip(*held, strict=True))[1:]]


def _shorter(keys: np.ndarray, n: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of the last `symbols` symbols, and their counts."""
    keys = keys & ((1 << (8 * symbols)) - 1)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def _of_context(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted runs: where each context begins, how many runs it has, and each run's context's total."""
    ctx = keys >> 8
    first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    width = np.diff(np.append(first, len(keys)))
    return first, width, np.repeat(np.add.reduceat(n, first), width)


def _tested_runs(grams: DataFrame, depth: int, at: int, floor: int, nats: float, least_kl: float) -> DataFrame:
    """(k, key, n, total, passed): the runs after contexts of k > at symbols that were seen `floor` times, passed marking
    the first run of each context that passes the tests; and all runs after contexts of `at` symbols, total 0.

    Runs are dealt by the last `at` symbols of their context, which all their longer and shorter forms share: one shuffle
    serves all lengths. A task holds the runs of some such symbols at a time; one has 256 ** (depth + 1 - at) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(k, keys, n, total, passed):
            return pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(keys), k, np.int32)), "key": pa.array(keys), "n": pa.array(n), "total": pa.array(total), "passed": pa.array(passed)})

        for keys, n in _whole_groups(batches):
            levels = [_shorter(keys, n, depth + 1)]
            for k in range(depth - 1, at - 1, -1):
                levels.append(_shorter(*levels[-1], k + 1))
            for k in range(depth, at, -1):
                (keys, n), (up, up_n) = levels[depth - k], levels[depth - k + 1]
                first, width, total = _of_context(keys, n)
                place = np.searchsorted(up, keys & ((1 << (8 * k)) - 1))
                gain = np.add.reduceat(n * np.log(n / total / (up_n / _of_context(up, up_n)[2])[place]), first)
                passed = np.zeros(len(keys), bool)
                passed[first] = (gain >= nats * width) & (gain >= least_kl * total[first])
                kept = total >= floor
                yield batch_of(k, keys[kept], n[kept], total[kept], passed[kept])
            keys, n = levels[-1]
            yield batch_of(at, keys, n, np.zeros(len(keys), np.int64), np.zeros(len(keys), bool))

    dealt = grams.select(_low("key", at + 1).alias("t"), "key", "n").withColumn("t", F.shiftrightunsigned("t", 8))
    return C.staged(dealt.repartition("t").sortWithinPartitions("t").mapInArrow(run, "k int, key long, n long, total long, passed boolean"), "runs")


def _steps(depth: int) -> list[tuple[int, int]]:
    """Lengths of contexts that share a shuffle, (longest, the length that deals them): 6 to 4, 4 to 2, 2 to 1, 1 to 0."""
    steps = []
    while depth:
        steps.append((depth, depth - (2 if depth > 3 else 1)))
        depth = steps[-1][1]
    return steps


def _contexts(grams: DataFrame, depth: int, floor: int, nats: float, least_kl: float) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(k, ctx) of contexts that pass the tests and of all their parts; for each step (k, key, n, total) of the runs whose
    contexts were seen often enough; and (key, n) of single symbols."""
    longer, passed, rows = [], None, grams
    for top, at in _steps(depth):
        runs = _tested_runs(rows, top, at, floor, nats, least_kl)
        rows = runs.filter(F.col("k") == at).select("key", "n")
        longer.append(runs.filter(F.col("k") > at).select("k", "key", "n", "total"))
        found = runs.filter((F.col("k") > at) & F.col("passed")).select("k", F.shiftrightunsigned("key", 8).alias("ctx"))
        passed = found if passed is None else passed.unionByName(found)
    parts = passed.select("k", "ctx", F.explode(F.sequence(F.lit(1), "k")).alias("m"))
    parts = parts.select("ctx", "m", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("m"))).alias("after"))
    part = F.expr("shiftrightunsigned(ctx, 8 * after) & (shiftleft(1L, 8 * m) - 1)")
    return C.staged(parts.select(F.col("m").alias("k"), part.alias("ctx")).distinct(), "states"), longer, rows


def _smoothed_runs(longer: DataFrame, states: DataFrame, shortest: DataFrame, depth: int, at: int, beta: float) -> DataFrame:
    """(k, key, ctx, n, total, prob) of the runs in `longer` whose contexts are states, dealt as in `_tested_runs`.
    `shortest` has the same of contexts of `at` symbols, as far as they are states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, key, n, total, prob in _whole_groups(batches):
            of = np.flatnonzero((k == at) & (n > 0))
            order = of[np.argsort(key[of])]
            up, up_prob = key[order], prob[order]
            for m in range(at + 1, depth + 1):
                contexts = np.sort(key[(k == m) & (n == 0)])
                of = np.flatnonzero((k == m) & (n > 0))
                order = of[np.argsort(key[of])]
                order = order[_found(contexts, key[order] >> 8)[1]]
                own, c, t = key[order], n[order], total[order]
                own_prob = (c + beta * up_prob[np.searchsorted(up, own & ((1 << (8 * m)) - 1))]) / (t + beta) if len(own) else np.empty(0)
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(own), m, np.int32)), "key": pa.array(own), "ctx": pa.array(own >> 8), "n": pa.array(c), "total": pa.array(t), "prob": pa.array(own_prob)})
                up, up_prob = own, own_prob

    none, names = F.lit(0).cast("long"), ("k", "key", "n", "total", "prob")
    last = lambda ctx: ctx.bitwiseAND(F.lit((1 << (8 * at)) - 1)).alias("t")
    rows = longer.withColumn("prob", F.lit(0.0)).unionByName(shortest.select(*names)).select(last(F.shiftrightunsigned("key", 8)), *names)
    marks = states.filter((F.col("k") > at) & (F.col("k") <= depth)).select(last(F.col("ctx")), "k", F.col("ctx").alias("key"), none.alias("n"), none.alias("total"), F.lit(0.0).alias("prob"))
    return C.staged(rows.unionByName(marks).repartition("t").sortWithinPartitions("t").mapInArrow(run, "k int, key long, ctx long, n long, total long, prob double"), "next")


def fit_states(counts: DataFrame, depth: int, least: int, share: float, nats: float, least_kl: float, beta: float) -> tuple[np.ndarray, DataFrame]:
    """Counts of single symbols, and (k, key, ctx, n, total, prob): of each state the symbols seen next."""
    grams = counts.filter("kind = 1").select("key", "n")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    states, longer, symbols = _contexts(grams, depth, max(least, math.ceil(total * share)), nats, least_kl)
    root = np.zeros(256, np.int64)
    for key, n in symbols.toLocalIterator():  # 256 at most
        root[key] = n
    above = symbols.select(F.lit(0).alias("k"), "key", "n", F.lit(total).cast("long").alias("total"), ((F.col("n") + 0.5) / (total + 128)).alias("prob"))
    entries = None
    for (top, at), runs in zip(reversed(_steps(depth)), reversed(longer), strict=True):
        own = _smoothed_runs(runs, states, above, top, at, beta)
        above = own.filter(F.col("k") == top)
        entries = own if entries is None else entries.unionByName(own)
    return root, entries


def _back(total: Column, beta: float) -> Column:
    return F.log10(beta / (total + beta))


def _automaton(root: np.ndarray, entries: DataFrame, depth: int, beta: float) -> Tree:
    per: dict[bytes, tuple[np.ndarray, np.ndarray]] = {b"": (np.arange(256, dtype=np.uint8), root)}
    t = entries.select("k", "ctx", "key", "n").orderBy("k", "key").toArrow()
    k, ctx, key, n = (t.column(i).to_numpy() for i in range(4))
    cuts = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (k[1:] != k[:-1]), [True]))) if len(k) else np.zeros(1, int)
    for a, b in zip(cuts, cuts[1:]):
        per[int(ctx[a]).to_bytes(8, "big")[8 - int(k[a]) :]] = ((key[a:b] & 255).astype(np.uint8), n[a:b])
    letters = np.flatnonzero((root > 0) | (np.arange(256) == END)).astype(np.uint8)
    per[b""] = (letters, root[letters])
    return Tree(depth, letters, sorted(per, key=lambda s: (len(s), s)), per, beta)


class HeldStates:
    """Where tables of the states held lie in the shared folder: tasks wrote them, sorted, and each worker reads them once into
    arrays. Nothing but their paths goes through the driver."""

    def __init__(self, depth: int, root: np.ndarray, tables: dict[str, str]):
        self.depth, self.root, self.tables = depth, root, tables

    def load(self) -> Backoff:
        if (name := self.tables["runs"]) not in _loaded:
            _loaded.clear()
            runs, contexts, beyond = (self._columns(x) for x in ("runs", "contexts", "beyond"))
            levels = [(*runs[k], *contexts[k]) for k in range(1, self.depth + 1)]
            _loaded[name] = Backoff(self.depth, self.root, levels, [x[0] for x in beyond])
        return _loaded[name]

    def _columns(self, name: str) -> list[list[np.ndarray]]:
        """Columns after k, by k; the first one sorted."""
        fs, at = open_fs(self.tables[name])
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
        parts: list[list] = [[] for _ in range(self.depth + 1)]
        for path in files:
            table = pq.read_table(path, filesystem=fs)
            k, *columns = (table.column(i).to_numpy() for i in range(table.num_columns))
            edges = np.searchsorted(k, np.arange(self.depth + 2))
            for m in range(self.depth + 1):
                parts[m].append([c[edges[m] : edges[m + 1]] for c in columns])
        out = []
        for own in parts:
            joined = [np.concatenate(c) for c in zip(*own, strict=True)] if own else [np.empty(0, np.int64)] * 2
            order = np.argsort(joined[0], kind="stable")
            out.append([joined[0][order].view(np.uint64), *(c[order] for c in joined[1:])])
        return out


_loaded: dict[str, Backoff] = {}


def _held(root: np.ndarray, entries: DataFrame, depth: int, beta: float, most: int) -> HeldStates:
    """The states seen most often, as many whole classes of counts as have at most `most` entries. States are seen no more
    often than their suffixes, so that these are held too."""
    rank = F.floor(8 * F.log2("total"))
    cut, rows = 1 << 30, 0
    for c, w in entries.groupBy(rank.alias("c")).agg(F.count("*").alias("w")).orderBy(F.desc("c")).collect():
        rows += w
        if rows > most:
            break
        cut = c
    told = entries.withColumn("held", rank >= cut)
    states = told.groupBy("k", "ctx").agg(F.first("total").alias("total"), F.first("held").alias("held"))
    parent = F.expr("shiftleft(1L, 8 * (k - 1)) - 1")
    beyond = states.filter("NOT held").select((F.col("k") - 1).alias("k"), F.col("ctx").bitwiseAND(parent).alias("ctx")).distinct()
    roots = beyond.filter("k = 0").select("k", "ctx")
    beyond = beyond.join(states.filter("held").select("k", "ctx"), ["k", "ctx"]).select("k", "ctx").unionByName(roots)
    wanted = {
        "runs": told.filter("held").select("k", "key", F.log10("prob").cast("float").alias("log10")),
        "contexts": states.filter("held").select("k", "ctx", _back(F.col("total"), beta).cast("float").alias("back")),
        "beyond": beyond,
    }
    tables = {}
    for name, df in wanted.items():
        tables[name] = C.new_path(entries.sparkSession, f"held-{name}")
        df.sortWithinPartitions("k", df.columns[1]).write.parquet(tables[name])
    return HeldStates(depth, np.log10((root + 0.5) / (root.sum() + 128)), tables)


def _beyond(open_runs: DataFrame, entries: DataFrame, depth: int, beta: float) -> DataFrame:
    """(row, more): sums over the runs (row, key with the length held, v) whose states are not all held."""
    runs = open_runs.groupBy("row", "key").agg(F.count("*").alias("times"), F.first("v").alias("v"))
    # Only states beyond those held are met: each was seen too seldom to make a hot key.
    asked = runs.select("key").distinct().select("key", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _low("key", k + 1).alias("sub"), F.shiftrightunsigned(_low("key", k + 1), 8).alias("ctx")) for k in range(1, depth + 1)))).alias("p"))
    asked = asked.select("key", "p.*").filter(F.col("k") > F.shiftrightunsigned("key", 56))
    states = entries.groupBy("k", "ctx").agg(_back(F.first("total"), beta).alias("back"))
    met = asked.join(states, ["k", "ctx"]).join(entries.select("k", F.col("key").alias("sub"), F.log10("prob").alias("log10")), ["k", "sub"], "left")
    best = F.max(F.when(F.col("log10").isNotNull(), F.struct("k", "log10")))
    by_key = met.groupBy("key").agg(best.alias("best"), F.collect_list(F.struct("k", "back")).alias("backs"))  # no more than depth
    longer = F.filter("backs", lambda x: x["k"] > F.coalesce("best.k", F.lit(0)))
    lost = F.aggregate(longer, F.lit(0.0), lambda a, x: a + x["back"])
    by_key = by_key.select("key", F.col("best.log10").alias("log10"), lost.alias("lost"))
    joined = runs.join(by_key, "key", "left")
    return joined.groupBy("row").agg(F.sum(F.col("times") * (F.coalesce("log10", "v") + F.coalesce("lost", F.lit(0.0)))).alias("more_score"))


def score_texts(documents: DataFrame, held_fold: int = 10, id_col: str = "doc_id", text_col: str = "text", depth: int = 6, least: int = 20, share: float = 0.0, nats: float = 1.0, least_kl: float = 0.05, beta: float = 5.0, broadcast_words: int = 400_000, dense_states: int = 20_000, held_runs: int = 6_000_000) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    fold = C.crc_mod(id_col, held_fold)
    counts = C.staged(training_counts(documents.filter(fold != 0), depth, text_col), "counts")
    words = counts.filter("kind = 0").select("key", "n")
    of_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_tokens, v = of_words + ends, distinct + (ends > 0)
    below = n_tokens + 0.1 * (v + 1)
    root, entries = fit_states(counts, depth, least, share, nats, least_kl, beta)
    few = entries.select("k", "ctx").distinct().count() <= dense_states
    tree = _automaton(root, entries, depth, beta) if few else _held(root, entries, depth, beta, held_runs)
    # The words met most often: as many whole classes of counts as the bound takes.
    cut, sum_words = 1 << 62, 0
    for c, w in words.groupBy(F.least("n", F.lit(100_000)).alias("c")).agg(F.count("*").alias("w")).orderBy(F.desc("c")).toLocalIterator():
        sum_words += w
        if sum_words > broadcast_words:
            break
        cut = c
    often = words.filter(F.col("n") >= cut).orderBy("key").toArrow()
    keys = often.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((tree, keys[order], often.column(1).to_numpy()[order]))
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, rare array<long>, open array<struct<key: long, v: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, keys, n = shared.value
        tree = tree.load() if isinstance(tree, HeldStates) else tree
        row = TaskContext.get().partitionId() << 36
        logs = np.log10((n + 0.1) / below)
        end = math.log10((ends + 0.1) / below)
        for batch in batches:
            for at, to, texts in C.text_groups(batch.column(2), 2 << 20):
                raw, begins = streams(texts, tree.depth)
                buf = np.frombuffer(raw, np.uint8)
                starts, stops = C.word_bounds(buf, C.SPACED)
                h = C.word_hashes(buf, starts, stops)
                one, back = np.unique(h, return_inverse=True)
                place = np.minimum(np.searchsorted(keys, one), max(0, len(keys) - 1))
                known = keys[place] == one if len(keys) else np.zeros(len(one), bool)
                value = np.zeros(len(one))
                value[known] = logs[place[known]]
                known = known[back]
                first = np.append(np.searchsorted(starts, begins), len(h))
                sums = np.concatenate(([0.0], np.cumsum(value[back])))
                sure = np.concatenate(([0], np.cumsum(known)))
                score = tree.score(raw, begins)
                score, keys_open, v_open, open_at = score if isinstance(score, tuple) else (score, np.empty(0, np.uint64), np.empty(0), np.zeros(len(texts) + 1, int))
                rare_h, rare_at = h[~known].view(np.int64), np.concatenate(([0], np.cumsum(~known)))[first]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(at, to - at),
                    "held_out": batch.column(1).slice(at, to - at),
                    "row": pa.array(row + np.arange(len(texts))),
                    "n_tokens": pa.array(np.diff(first) + 1),
                    "n_known": pa.array(sure[first[1:]] - sure[first[:-1]] + int(ends > 0)),
                    "base": pa.array(sums[first[1:]] - sums[first[:-1]] + end),
                    "score": pa.array(score),
                    "rare": pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(rare_h)),
                    "open": pa.ListArray.from_arrays(pa.array(open_at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(keys_open.view(np.int64)), pa.array(v_open)], ["key", "v"])),
                })
                row += len(texts)

    scored = C.staged(documents.select(F.col(id_col).alias("id"), (fold == 0).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    met = rare.join(words.filter(F.col("n") < cut), "key", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    added = met.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / F.lit(below))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.drop("rare", "open").join(added, "row", "left")
    if not few:
        out = out.join(_beyond(scored.select("row", F.explode("open").alias("o")).select("row", "o.*"), entries, depth, beta), "row", "left")
    else:
        out = out.withColumn("more_score", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(C.table(spark, sf_dir, "documents"))
