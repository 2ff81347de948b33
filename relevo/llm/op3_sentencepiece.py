"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into units (spaces, then the characters up to the next space; a space is put before a text), and the
   distinct units are counted. No piece reaches over a unit's end, so units are encoded apart.
2. Every substring of a unit of at most the longest piece's length is exploded and meets the piece table in an equi-join;
   the matches, grouped by unit, are the edges of its lattice. Units are dealt to tasks once, before that.
3. A Spark higher-order ``aggregate`` folds each lattice to ids. Unigram models: Viterbi, the best sum of scores (ties:
   the longer last piece). BPE models: scores are merge ranks, whose sum means nothing, so the fold merges the two
   neighbours whose joint piece ranks first (ties: leftmost) until none is left, which is what such a model defines.
   Characters without a piece become their UTF-8 bytes' pieces.
4. The unit table goes to the tasks as sorted hashes and ids, at most MAX_UNITS units (the most frequent; about 30 bytes
   each). Rarer units, longer ones and runs of spaces are encoded where they occur, by the sentencepiece library, which
   gives the same ids (tested with an empty table).

Decoding joins the pieces' bytes, turns the mark of a space into a space and drops the leading one.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581, which the format uses for a space,
decodes to a space; ids, ties, repeated rows and other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.llm import held
from relevo.llm import words as W
from relevo.session import bounded_batches, materialize

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MAX_UNITS = 500_000
MAX_CHARS = 32
#: Bytes of a batch of the pipeline's last step.
STAGE_BATCH_BYTES = 2 << 20
UNITS_A_TASK = 20_000
#: The library scores an unknown character so much below the lowest piece.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class Model:
    """Pieces of a .model file: text (spaces for marks), score, and what byte pieces stand for."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.data = f.read()
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        self.kind = next((v for n, v in _fields(next(v for n, v in _fields(self.data) if n == 2)) if n == 3), UNIGRAM)
        sp = self.lib
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = [(sp.id_to_piece(i).replace(MARK, " "), i, float(sp.get_score(i))) for i in plain]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.unknown = min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY
        raw = [b""] * sp.get_piece_size()
        for p, i, _ in self.pieces:
            raw[i] = p.encode()
        for b, i in self.byte_id.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_end = np.cumsum([len(r) for r in raw])


def model_of(path: str) -> Model:
    return held.one("pieces", path, lambda: Model(path))


def count_units(docs: DataFrame, max_units: int = MAX_UNITS) -> DataFrame:
    """(unit): the units with one space and at most MAX_CHARS characters, all of them or those that occur most."""
    words = F.split(F.translate(F.col("text").cast("string"), MARK, " "), " ")
    n = docs.select(F.explode(words).alias("w")).where((F.col("w") != "") & (F.length("w") < MAX_CHARS)).groupBy("w").agg(F.count("*").alias("n"))
    n = materialize(n.select(F.concat(F.lit(" "), F.col("w")).alias("unit"), "n"), "units")
    if n.count() <= max_units:
        return n.select("unit")
    # the least count that still fits: a few distinct counts, not the units, are ranked
    by = n.groupBy("n").agg(F.count("*").alias("units")).withColumn("sum", F.sum("units").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    least = by.where(F.col("sum") <= max_units).agg(F.min("n")).first()[0]
    return n.where(F.col("n") >= least).select("unit") if least else n.select("unit").limit(0)


def lattice(spark: SparkSession, unit: DataFrame, model: Model) -> DataFrame:
    """(unit, edges, chars): the pieces found in each unit, as array<struct(s, e, score, id)>; ``chars`` holds those
    of one character."""
    pieces = spark.createDataFrame(model.pieces, "piece string, id int, score double")
    # dealt by unit before the substrings are made: nothing moves again up to the fold
    unit = unit.repartition(max(12, -(-unit.count() // UNITS_A_TASK)), "unit")
    starts = unit.select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    reach = F.least(F.lit(model.longest), F.length("unit") - F.col("s"))
    subs = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), reach)).alias("len")).select("unit", "s", (F.col("s") + F.col("len")).alias("e"), F.substring("unit", F.col("s") + 1, F.col("len")).alias("piece"))
    edge = F.struct("s", "e", "score", "id")  # the piece table is bounded by the model's vocabulary
    one = F.col("e") - F.col("s") == 1
    return (subs.join(F.broadcast(pieces), "piece").groupBy("unit")
            .agg(F.collect_list(F.when(~one, edge)).alias("edges"), F.collect_list(F.when(one, edge)).alias("chars")))


def _bytes_of(char: Column, model: Model) -> Column:
    """Ids of the byte pieces of a character."""
    table = F.array(*[F.lit(model.byte_id.get(b, model.lib.unk_id())) for b in range(256)])
    h = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.get(table, F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _ids_between(cuts: Column, model: Model) -> Column:
    """Ids of the pieces between neighbouring cuts of ``unit``; a character without a piece becomes bytes."""
    def one(i: Column) -> Column:
        def found(c: Column) -> Column:
            hit = F.filter(F.when(c["e"] - c["s"] > 1, F.col("edges")).otherwise(F.col("chars")), lambda x: (x["s"] == c["s"]) & (x["e"] == c["e"]))
            return F.coalesce(F.array(F.get(hit, 0)["id"]), F.array().cast("array<int>"))
        ids = _let(F.struct(F.get(cuts, i).alias("s"), F.get(cuts, i + 1).alias("e")), found)
        return _let(ids, lambda x: F.when(F.get(x, 0).isNotNull(), x).otherwise(_bytes_of(F.substring("unit", F.get(cuts, i) + 1, F.lit(1)), model)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), one))


def merge_fold(model: Model) -> Column:
    """Cuts of a BPE model: neighbours whose joint piece has the highest score are merged, leftmost first among equals."""
    def step(cuts: Column, _: Column) -> Column:
        # an edge can be merged if exactly one cut lies inside it
        open_ = F.filter("edges", lambda x: _let(F.array_position(cuts, x["s"]), lambda p: (p > 0) & (F.get(cuts, (p + 1).cast("int")) == x["e"])))
        best = F.array_max(F.transform(open_, lambda x: F.struct(x["score"].alias("score"), (-x["s"]).alias("left"), x["e"].alias("e"))))
        return _let(best, lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= -b["left"]) | (c >= b["e"]))))

    return F.aggregate(F.sequence(F.lit(1), F.length("unit")), F.sequence(F.lit(0), F.length("unit")), step)


def viterbi_fold(model: Model) -> Column:
    """For every position of a unit the best score to reach it, and where its last piece starts (negated)."""
    def step(best: Column, end: Column) -> Column:
        here = F.filter(F.concat("edges", "chars"), lambda x: x["e"] == end)
        ways = F.transform(here, lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("left")))
        # a character without a piece is an edge of its own; among equals the smaller start wins
        odd = F.struct((F.get(best, end - 1)["score"] + F.lit(model.unknown)).alias("score"), (1 - end).alias("left"))
        ways = F.when(F.exists("chars", lambda x: x["e"] == end), ways).otherwise(F.concat(ways, F.array(odd)))
        return F.concat(best, F.array(F.array_max(ways)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("left")))
    return F.aggregate(F.sequence(F.lit(1), F.length("unit")), start, step)


def _backtrack(best: str) -> Column:
    """Cuts of the best path, from the last position back."""
    def back(cuts: Column, _: Column) -> Column:
        return F.when(F.get(cuts, 0) == 0, cuts).otherwise(F.concat(F.array(-F.get(F.col(best), F.get(cuts, 0))["left"]), cuts))

    return F.aggregate(F.sequence(F.lit(1), F.length("unit")), F.array(F.length("unit")), back)


def unit_ids(spark: SparkSession, unit: DataFrame, model: Model) -> DataFrame:
    """(unit, ids)."""
    edges = lattice(spark, unit, model)
    if model.kind == BPE:
        cut = edges.withColumn("cuts", merge_fold(model))
    else:
        cut = edges.withColumn("best", viterbi_fold(model)).withColumn("cuts", _backtrack("best"))
    return cut.select("unit", _ids_between(F.col("cuts"), model).alias("ids"))


def _hashed(batches):
    for batch in batches:
        col = batch.column("unit")
        data, offs = W.text_bytes(col)
        own = W.Words(data, offs[:-1], offs[1:], np.arange(len(offs)))
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        end = np.cumsum(pc.list_value_length(ids).to_numpy())
        blobs = [flat[a:b].tobytes() for a, b in zip([0, *end[:-1]], end, strict=True)]
        yield pa.record_batch([W.int64(own.hashes(1)), W.int64(own.hashes(2)), pa.array(blobs, pa.binary())], names=["h", "check", "ids"])


class UnitTable:
    """Sorted hashes of units, a second hash of each, and their ids end to end."""

    def __init__(self, rows: pa.Table):
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.h, self.check = h[order], rows.column("check").to_numpy().view(np.uint64)[order]
        col = rows.column("ids").take(pa.array(order)).combine_chunks()
        col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks or [pa.array([], pa.binary())])
        n = pc.binary_length(col).to_numpy(zero_copy_only=False) // 4
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(col.to_pylist()), dtype="<u4")


def _spread(flat: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[first[p]:first[p + 1]] for each p of ``pick``, end to end, and the length of each."""
    n = first[pick + 1] - first[pick]
    shift = np.repeat(first[pick] - (np.cumsum(n) - n), n)
    return flat[np.arange(int(n.sum())) + shift], n


def encode_column(col: pa.Array, table: UnitTable, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's ids start."""
    col = pc.replace_substring(pc.fill_null(col.cast(pa.large_string()), ""), pattern=MARK, replacement=" ")
    col = pc.if_else(pc.equal(col, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), col, pa.scalar(" ", pa.large_string())))
    data, offs = W.text_bytes(col)
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    start[edge] = True
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, offs)
    own = W.Words(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, first)
    h = own.hashes(1)
    at = np.minimum(np.searchsorted(table.h, h), max(0, len(table.h) - 1))
    ok = (table.h[at] == h) & (table.check[at] == own.hashes(2)) if len(table.h) else np.zeros(len(h), dtype=bool)
    flat, begin = table.flat, table.first
    if not ok.all():  # encoded here, once per distinct unit of the slice
        lost = np.flatnonzero(~ok)
        text = [data[a:b].tobytes() for a, b in zip(own.starts[lost], own.ends[lost], strict=True)]
        number: dict[bytes, int] = {}
        for t in text:
            number.setdefault(t, len(number))
        more = model.lib.encode([t.decode()[1:] for t in number], num_threads=1) if number else []
        # the library puts a space before a text; a unit that is one space only is that space
        more = [m if len(t) > 1 else [model.lib.piece_to_id(MARK)] for t, m in zip(number, more, strict=True)]
        at = at.copy()
        at[lost] = len(begin) - 1 + np.array([number[t] for t in text])
        begin = np.concatenate([begin, begin[-1] + np.cumsum([len(m) for m in more])])
        flat = np.concatenate([flat, np.array([i for m in more for i in m], dtype="<u4")])
    ids, n = _spread(flat, begin, at)
    return ids, np.concatenate([[0], np.cumsum(n)])[first]


def decode_ids(ids: np.ndarray, first: np.ndarray, model: Model) -> list[bytes]:
    """UTF-8 of each text."""
    data, n = _spread(model.raw, np.concatenate([[0], model.raw_end]), ids.astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(n)])[first]
    return [data[a:b].tobytes().removeprefix(b" ") for a, b in zip(ends, ends[1:], strict=False)]


def unit_table(docs: DataFrame, path: str, max_units: int = MAX_UNITS) -> UnitTable:
    """The lattice's answers for the units of ``docs``, collected: at most ``max_units`` of them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = materialize(unit_ids(spark, count_units(docs, max_units), model_of(path)).mapInArrow(held.tidy(_hashed), "h long, check long, ids binary"), "unit-ids")
    return UnitTable(rows.toArrow())


def _encode(table, path: str):
    def run(batches):
        model = model_of(path)
        for batch in batches:
            for part in W.slices(batch):
                ids, first = encode_column(part.column("text"), table.value, model)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), part.column("text"), lists], names=["doc_id", "text", "ids"])

    return held.tidy(run, "pieces")


def encode(docs: DataFrame, path: str, max_units: int = MAX_UNITS) -> DataFrame:
    """(doc_id, text, ids array<int>) of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(unit_table(rows, path, max_units))
    return rows.mapInArrow(_encode(table, path), "doc_id long, text string, ids array<int>")


def _decode(path: str):
    def run(batches):
        model = model_of(path)
        for batch in batches:
            ids = pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = decode_ids(ids.flatten().to_numpy(), first, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*batch.schema.names, "decoded"])

    return held.tidy(run, "pieces")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with ids array<int>) and their text as ``decoded``; bytes that aren't UTF-8 become U+FFFD."""
    from pyspark.sql import types as T

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(_decode(path), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def _digest(table, path: str):
    def run(batches):
        model = model_of(path)
        for batch in batches:
            for part in W.slices(batch):
                ids, first = encode_column(part.column("text"), table.value, model)
                texts = decode_ids(ids, first, model)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
                same = [t == (x or "").replace(MARK, " ").encode() for t, x in zip(texts, part.column("text").to_pylist(), strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(crc, pa.int64()),
                                       pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return held.tidy(run, "pieces")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), decoded_sha256, round_trip."""
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = spark.sparkContext.broadcast(unit_table(docs, path))
    return docs.mapInArrow(_digest(table, path), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def _there_and_back(table, path: str):
    def run(batches):
        model = model_of(path)
        for batch in batches:
            for part in W.slices(batch):
                ids, first = encode_column(part.column("text"), table.value, model)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                texts = [t.decode("utf-8", "replace") for t in decode_ids(ids, first, model)]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), lists, pa.array(texts, pa.string())],
                                      names=["doc_id", "n_tokens", "ids", "text"])

    return held.tidy(run, "pieces")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to, of every document. One Python step does both ways, so a
    task keeps one worker."""
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(unit_table(rows, path))
    # ids and texts go both ways at once: smaller batches than elsewhere, for this step and what follows it
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key, "").rstrip("b")
    if have.isdigit() and int(have) > STAGE_BATCH_BYTES:
        spark.conf.set(key, str(STAGE_BATCH_BYTES))
    return rows.mapInArrow(_there_and_back(table, path), "doc_id long, n_tokens long, ids array<int>, text string")
