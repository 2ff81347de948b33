"""Periodic runs of words, found in a grammar of the text.

The words of each document are numbered and compressed by Re-Pair: in rounds, pairs of neighbouring symbols that occur
at least twice in the document become new symbols. A round replaces every pair that is more frequent than the pairs that overlap it
(ties by a hash, so a passage that repeats shrinks by a constant factor a round), and ends when no pair
occurs twice. What is left of a text is joined by a balanced tree. Each symbol then stands for a stretch of text with one
boundary inside, and every run lies, whole, in the smallest stretch that holds it and crosses its boundary.

So runs are looked for once per symbol, across its boundary only: at least half of a run of four periods lies on one side
of it, where the two words at the boundary occur again at the distance of the period. Such distances are
tested on whole periods by hashes of stretches, and the ends of a run by bisection over such hashes. Runs of a symbol
are translated to all places where the symbol was put, and of the intervals with one period those inside
others go: a run may be cut where a symbol ends, and then a larger symbol holds all of it. Runs that remain are checked word by word.

A bigram that occurs once in a document can lie in no run, so texts are cut there first; only stretches of six
words or more between such bigrams are compressed. All of this is numpy over slices of many documents at
once, inside ``mapInArrow``; a document is never split, and no row meets another.

Defined cases: null text and texts without words have no runs and an empty collapsed text; null ids are kept and (in the query) not made
periodic; repeated rows are separate; other columns are carried; an empty table gives no rows; a text of any length is handled whole, in
memory of about 300 bytes a word of its repetitive stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from relevo.llm.words import Words, mix, powers, slices, whole, words_of
from relevo.session import bounded_batches

#: A run has at least this many words and periods.
MIN_LENGTH = 6
MIN_PERIODS = 4
#: Distances that are tested at once.
CHUNK = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of ``counts[i]`` elements for each i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated_stretches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of at least MIN_LENGTH words all of whose bigrams occur twice in their document.

    ``h`` has a hash for each word that differs between documents; words ``first[d]:first[d+1]`` are document d's."""
    none = np.empty(0, dtype=np.int64)
    if len(h) < MIN_LENGTH:
        return none, none
    at = whole(first, 2)
    key = mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1])
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(h) + 1, dtype=bool)   # twice[i]: the bigram of words i-1, i; a document's first word has none
    twice[at[order[1:]][same] + 1] = True
    twice[at[order[:-1]][same] + 1] = True
    edge = np.diff(np.concatenate(([0], twice.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
    long = ends - starts >= MIN_LENGTH
    return starts[long], ends[long]


def re_pair(sym: np.ndarray, seg: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """Compress symbols ``sym`` (0 .. k-1, no symbol in two documents); neighbours in different ``seg`` are never paired.

    Returns rules as (start, boundary, end) of one place of each new symbol, all places as (rule, start), and
    what is left as (segment, start, end) of its symbols."""
    sym, seg = sym.astype(np.int64), seg.astype(np.int64)
    pos = np.arange(len(sym), dtype=np.int64)
    end = pos + 1
    fresh = int(sym.max(initial=-1)) + 1
    dead = np.zeros(len(sym), dtype=bool)      # the pair that starts here occurs once, and always will
    rules, places, made = [], [], 0
    while len(sym) > 1:
        left, right = sym[:-1], sym[1:]
        can = (seg[:-1] == seg[1:]) & ~dead[:-1]
        # of overlapping pairs of one symbol, every other one
        equal = (left == right) & (seg[:-1] == seg[1:])
        if equal.any():
            n = np.arange(len(equal))
            can &= ~equal | ((n - np.maximum.accumulate(np.where(equal, -1, n)) - 1) % 2 == 0)
        at = np.flatnonzero(can)
        if not len(at):
            break
        key = left[at] * fresh + right[at]
        kinds, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[kind]
        dead[at[(often < 2) & (left[at] != right[at])]] = True
        rank = np.zeros(len(sym) + 1, dtype=np.uint64)
        live = often >= 2
        rank[at[live] + 1] = (often[live].astype(np.uint64) << np.uint64(32)) | (mix(kinds.astype(np.uint64) + np.uint64(1))[kind[live]] >> np.uint64(32))
        own = rank[1:-1]
        before, after = rank[:-2], rank[2:]
        pick = np.flatnonzero((own > before) & (own > after) & (own > 0))
        k = kind[np.searchsorted(at, pick)]
        picked = np.bincount(k, minlength=len(kinds))
        pick, k = pick[picked[k] >= 2], k[picked[k] >= 2]
        if not len(pick):
            break
        used, one, new = np.unique(k, return_index=True, return_inverse=True)
        rules.append((pos[pick[one]], end[pick[one]], end[pick[one] + 1]))
        places.append((made + new, pos[pick]))
        made += len(used)
        sym[pick] = fresh + new
        fresh += len(used)
        end[pick] = end[pick + 1]
        dead[pick] = False
        dead[pick[pick > 0] - 1] = False
        keep = np.ones(len(sym), dtype=bool)
        keep[pick + 1] = False
        sym, seg, pos, end, dead = sym[keep], seg[keep], pos[keep], end[keep], dead[keep]
    none = np.empty(0, dtype=np.int64)
    join = lambda xs, n: tuple(np.concatenate(x) for x in zip(*xs, strict=True)) if xs else (none,) * n
    return join(rules, 3), join(places, 2), (seg, pos, end)


def balanced(seg: np.ndarray, pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, boundary, end) of the nodes of a balanced tree over the symbols of each segment."""
    out = []
    while len(seg) > 1:
        head = np.concatenate(([True], seg[1:] != seg[:-1]))
        n = np.arange(len(seg))
        left = np.flatnonzero(((n - np.maximum.accumulate(np.where(head, n, 0))) % 2 == 0) & np.concatenate((~head[1:], [False])))
        if not len(left):
            break
        out.append((pos[left], end[left], end[left + 1]))
        end = end.copy()
        end[left] = end[left + 1]
        keep = np.ones(len(seg), dtype=bool)
        keep[left + 1] = False
        seg, pos, end = seg[keep], pos[keep], end[keep]
    none = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none,) * 3


class _Stretches:
    """Hashes of stretches of ``h``, and how far two places agree."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers(11, max(1, len(h))), out=self.sums[1:])
        self.powers = powers(11, len(h) + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether ``n`` words from ``a`` equal those from ``b``; a <= b."""
        return (self.sums[a + n] - self.sums[a]) * self.powers[b - a] == self.sums[b + n] - self.sums[b]

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, at most ``most``, agree from ``a`` and ``b`` on (back: before them); a <= b."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            n = (low[open_] + high[open_] + 1) >> 1
            x, y = a[open_], b[open_]
            ok = self.equal(x - n, y - n, n) if back else self.equal(x, y, n)
            low[open_[ok]], high[open_[~ok]] = n[ok], n[~ok] - 1


def crossing_runs(h: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs of each node start:end that cross its boundary, as far as the node reaches.

    Periods may be multiples of the smallest one, and a run may come twice."""
    out = []
    big = np.flatnonzero(end - start >= MIN_LENGTH)
    hashes = _Stretches(h)
    for side in (0, 1):
        room = (end - mid if side == 0 else mid - start)[big]
        most = np.minimum(room // (MIN_PERIODS // 2), (end - start)[big] // MIN_PERIODS)
        todo = big[most > 0]
        most = most[most > 0]
        upto = np.cumsum(most)
        for i in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):
            # distances i .. i+CHUNK of all nodes in a row; a large node may take several turns
            number = np.arange(i, min(i + CHUNK, int(upto[-1])))
            owner = np.searchsorted(upto, number, side="right")
            q = number - (upto[owner] - most[owner]) + 1
            node = todo[owner]
            b = mid[node]
            far = b + q if side == 0 else b - q
            ok = np.flatnonzero(h[far] == h[b])
            ok = ok[h[far[ok] - 1] == h[b[ok] - 1]]
            node, q, b = node[ok], q[ok], b[ok]
            # one whole period and the one after it, on the side that has two
            ok = hashes.equal(b, b + q, q) if side == 0 else hashes.equal(b - 2 * q, b - q, q)
            node, q, b = node[ok], q[ok], b[ok]
            x = b if side == 0 else b - q
            forth = hashes.agree(x, x + q, end[node] - x - q, back=False)
            back = hashes.agree(x, x + q, x - start[node], back=True)
            s, e = x - back, x + q + forth
            ok = (e - s >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)) & (s < b) & (e > b)
            out.append((node[ok], s[ok], e[ok], q[ok]))
    none = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none,) * 4


def _maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """The intervals that lie in no other of the same period, with their smallest period."""
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    if not len(s):
        return s, e, q
    group = np.cumsum(np.concatenate(([0], np.diff(q) != 0)))
    reach = np.maximum.accumulate(e + group * (int(e.max()) + 1)) - group * (int(e.max()) + 1)
    inside = np.concatenate(([False], (group[1:] == group[:-1]) & (e[1:] <= reach[:-1])))
    s, e, q = s[~inside], e[~inside], q[~inside]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))
    return s[new], e[new], q[new]


def runs_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs, by start, then period, as word numbers of the slice.

    ``h`` has a 64-bit hash of each word, words ``first[d]:first[d+1]`` are document d's. Exact as far as equal hashes are equal words."""
    counts = np.diff(first)
    h = mix(h ^ mix(np.repeat(np.arange(1, len(counts) + 1).astype(np.uint64), counts)))
    starts, ends = repeated_stretches(h, first)
    none = np.empty(0, dtype=np.int64)
    if not len(starts):
        return none, none, none
    seg, place = _ragged(ends - starts)
    word = starts[seg] + place                       # the slice's number of each word that takes part
    h = h[word]
    sym = np.unique(h, return_inverse=True)[1]
    rules, (rule, at), left = re_pair(sym, seg)
    tail = balanced(*left)
    nodes = tuple(np.concatenate(x) for x in zip(rules, tail, strict=True))
    node, s, e, q = crossing_runs(h, *nodes)
    # runs of a rule, moved to every place of its symbol; a node of the tree has one place
    n_rules = len(rules[0])
    order = np.argsort(rule, kind="stable")
    many = np.bincount(rule, minlength=n_rules)
    begin = np.cumsum(many) - many
    own, of_tree = np.flatnonzero(node < n_rules), np.flatnonzero(node >= n_rules)
    owner, k = _ragged(many[node[own]])
    i = own[owner]
    to = at[order[begin[node[i]] + k]] - nodes[0][node[i]]
    s, e, q = (np.concatenate(x) for x in ((s[i] + to, s[of_tree]), (e[i] + to, e[of_tree]), (q[i], q[of_tree])))
    s, e, q = _maximal(s, e, q)
    s, e = word[s], word[e - 1] + 1
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _same_words(w: Words, a: int, b: int, n: int) -> bool:
    """Whether words a .. a+n are those from b on, byte by byte."""
    x, y = w.ends[a:a + n] - w.starts[a:a + n], w.ends[b:b + n] - w.starts[b:b + n]
    if not np.array_equal(x, y):
        return False
    owner, k = _ragged(x)
    return np.array_equal(w.data[w.starts[a:a + n][owner] + k], w.data[w.starts[b:b + n][owner] + k])


def _checked_runs(w: Words) -> tuple[np.ndarray, ...]:
    """``runs_of`` the words, compared byte by byte; should two words of a document share a hash, other hashes are taken."""
    seed = 1
    while True:
        s, e, q = runs_of(w.hashes(seed), w.first)
        if all(_same_words(w, a, a + p, z - a - p) for a, z, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True)):
            return s, e, q
        seed += 1


def _joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    at = np.flatnonzero(kept)
    last = np.zeros(len(kept), dtype=bool)
    upto = np.searchsorted(at, w.first)              # at[upto[d]:upto[d + 1]] are document d's
    last[at[upto[1:][upto[1:] > upto[:-1]] - 1]] = True
    size = w.ends[at] - w.starts[at] + ~last[at]     # with the blank after a word
    owner, k = _ragged(size)
    out = w.data[np.minimum(w.starts[at][owner] + k, max(0, len(w.data) - 1))]
    ends = np.cumsum(size)
    out[ends[~last[at]] - 1] = 32
    offsets = np.concatenate(([0], ends))[upto]
    return pa.LargeStringArray.from_buffers(len(w.first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _report(batch: pa.RecordBatch, text: str, kind: pa.DataType):
    """``batch`` in slices, with n_words, runs and collapsed."""
    for part in slices(batch, text):
        w = words_of(part.column(part.schema.get_field_index(text)))
        s, e, q = _checked_runs(w)
        doc = np.searchsorted(w.first, s, side="right") - 1
        offsets = np.searchsorted(doc, np.arange(len(part) + 1))
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (s - w.first[doc], e - s, q)], names=["start", "length", "period"]))
        # kept: outside of what follows the first period of a run
        n = len(w.starts)
        cover = np.cumsum(np.bincount(s + q, minlength=n + 1) - np.bincount(e, minlength=n + 1))[:n]
        extra = [pa.array(np.diff(w.first), pa.int64()), runs.cast(kind), _joined(w, cover == 0)]
        names = [*part.schema.names, "n_words", "runs", "collapsed"]
        yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=names)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, ``runs`` (start, length, period of every run, by start, then period) and ``collapsed``: the words that lie in
    no run beyond its first period, joined by one space. Columns of ``docs`` with these names are replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed").withColumn(text, F.col(text).cast("string"))
    made = StructType([*docs.schema.fields, *StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string").fields])
    kind = to_arrow_schema(made).field("runs").type

    def run(batches):
        for batch in batches:
            yield from _report(batch, text, kind)
    return docs.mapInArrow(run, made)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """``text``, but for one id in ten its words from a random one on become a short period over and over.

    The id's crc32 h picks them (h % 10 = 0): with g = h div 10, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one = F.transform(F.array(F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), F.floor(h / 10).alias("g"))), lambda x: F.struct(
        x["w"].alias("w"), x["n"].alias("n"), F.try_mod(x["g"], x["n"]).alias("a"),
        (F.floor((x["n"] - F.try_mod(x["g"], x["n"])) / (3 + x["g"] % 8)) + 1).alias("p")))
    new = F.transform(one, lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(
        x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "))[0]
    return F.when((h % 10 == 0) & (F.regexp_instr(text, F.lit(r"[^\x20\x09-\x0D]")) > 0), new).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("b", best).withColumn("lines", F.array_join(line, ""))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.before")).alias("start"), F.col("b.length").alias("length"),
                    (-F.col("b.shorter")).alias("period"), F.floor(1000 * F.col("b.length") / -F.col("b.shorter")).alias("exponent_milli"),
                    F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
