"""Clone detection: maximal runs of equal normalised tokens between files of a group.

Runs of ``WINDOW`` tokens and more count. Of the ``GRAM``-token grams of a file, those are seeds that have the least hash
of some ``SPREAD`` neighbours (winnowing). Equal places have equal seeds, so every such run has common seeds, and those
that lie within it by themselves follow each other in both files alike; only seeds that no common seed precedes or
follows on their diagonal (same pair of files, same offset) are kept, and of those only seeds from which ``LINES`` lines
may be equal, which short hashes of longer grams tell. Pairs travel between buckets of files as compressed columns, in
which texts and digests that copies share occur once, and meet the tokens there. What is shuffled thus grows with a fraction of the tokens and with
the runs, not with their lengths. Less than ``SPREAD`` tokens lie between the outer seeds of a run and its ends; they are
compared as texts, and so are a run's tokens in the end (by digests), so hash values never decide what is equal. All
occurrences of a seed are paired and all pairs are given.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.lexing import Token, tokens_of
from quarry.scratch import Scratch
from quarry.session import spread

#: Tokens in a window, lines of a clone.
WINDOW, LINES = 40, 10
#: Tokens in a gram, neighbours of which one is a seed. Seeds lie closer than a gram is long, so those that follow each other leave no gap.
GRAM, SPREAD = 21, 20
#: Lengths of the grams that tell how far a seed may be followed; the count beyond them says that the lines of the file do not suffice.
LEVELS = (24, 30, 38, 50, 70, 100, 160)
TOO_FEW = len(LEVELS) + 1
SNIPPET_LINES = 50
#: Files and bytes of their packed tokens in a bucket, about.
BUCKET_FILES, BUCKET_BYTES = 3000, 32 << 20
_ODD = 0x9E3779B97F4A7C15
_PLACED = ("_ID_", "_LIT_")


def token_table(files: DataFrame, group: str, path: str, content: str, keys: Sequence[str] = ()) -> DataFrame:
    """group, path, tokens (packed), ``keys``; one row per file. Under WINDOW tokens the packed tokens are empty."""
    schema = T.StructType([files.schema[group], T.StructField("path", T.StringType()), T.StructField("tokens", T.BinaryType()), *[files.schema[k] for k in keys]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for p, t in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist()):
                tokens = tokens_of(p or "", t.replace("\r\n", "\n")) if t else []
                packed.append(_pack(tokens) if len(tokens) >= WINDOW else b"")
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column(path), pa.array(packed, pa.binary()), *[batch.column(k) for k in keys]], names=[group, "path", "tokens", *keys])

    return spread(files.select(group, path, content, *keys)).mapInArrow(run, schema)


def _pack(tokens: list[Token]) -> bytes:
    """Counts, kinds (0: normal is the text, else a place holder), steps of lines and lengths (a byte each, large ones apart), texts."""
    kinds = bytes(0 if t.normal == t.text else 1 + _PLACED.index(t.normal) for t in tokens)
    steps = np.diff(np.array([t.line for t in tokens], "<i4"), prepend=np.int32(0)).astype("<i4")
    sizes = np.array([len(t.text) for t in tokens], "<i4")
    large = [x[x >= 255] for x in (steps, sizes)]
    counts = np.array([len(tokens), *map(len, large)], "<i4")
    parts = [counts, kinds, *[np.minimum(x, 255).astype(np.uint8) for x in (steps, sizes)], *large]
    return b"".join(bytes(x) for x in parts) + "".join(t.text for t in tokens).encode("utf-8", "surrogatepass")


def _unpack(b: bytes) -> tuple[list[str], list[str], np.ndarray]:
    """Normal and raw texts and lines of a file's tokens."""
    n, *large = np.frombuffer(b, "<i4", 3).tolist()
    at, sums = 12 + 3 * n, []
    for k, count in enumerate(large):
        x = np.frombuffer(b, np.uint8, n, 12 + (k + 1) * n).astype(np.int64)
        x[x == 255] = np.frombuffer(b, "<i4", count, at)
        at += 4 * count
        sums.append(np.cumsum(x))
    text, ends = b[at:].decode("utf-8", "surrogatepass"), sums[1].tolist()
    raw = [text[s:e] for s, e in zip([0, *ends], ends)]
    return [t if not k else _PLACED[k - 1] for t, k in zip(raw, b[12 : 12 + n])], raw, sums[0]


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of GRAM tokens."""
    n = len(codes) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x100000001B3) + codes[i : i + n] * np.uint64(2 * i + 1)
        h ^= h >> np.uint64(31)
    return h


def seeds_of(normal: list[str], lines: np.ndarray, known: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    """Of a file of WINDOW tokens and more: pos and h of its seeds, what is before and after (0: nothing), and how far equality must reach.

    ``forth`` and ``back`` hold a byte of hash per level of the gram that begins or ends with the seed, ``forth_n`` and
    ``back_n`` the levels that a run of LINES lines in this file is sure to cover.
    """
    known = {} if known is None else known
    for t in set(normal) - known.keys():
        known[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    codes, n = np.array([known[t] for t in normal], np.uint64), len(normal)
    with np.errstate(over="ignore"):
        h = _grams(codes)
        near = np.lib.stride_tricks.sliding_window_view(h, SPREAD)[:, ::-1]
        pos = np.unique(np.arange(len(near)) + SPREAD - 1 - np.argmin(near, axis=1))  # of equal hashes the last
        mine = h[pos]
        link = (mine[:-1] * np.uint64(_ODD) + mine[1:]) ^ (mine[1:] >> np.uint64(29)) ^ (np.diff(pos).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        link = np.where(link == 0, np.uint64(1), link)
        none = np.zeros(1, np.uint64)
        powers = np.cumprod(np.full(n, _ODD, np.uint64))
        turned = np.cumprod(np.full(n + 1, pow(_ODD, -1, 1 << 64), np.uint64))
        sums = np.concatenate([none, np.cumsum(codes * powers)])
        sides = {}
        for name, sign in (("forth", 1), ("back", -1)):
            bits = np.zeros(len(pos), np.uint64)
            for i, size in enumerate(LEVELS):
                start = pos if sign > 0 else pos + GRAM - size
                ok = (start >= 0) & (start + size <= n)
                s = np.where(ok, start, 0)
                value = ((sums[np.where(ok, s + size, 0)] - sums[s]) * turned[s]) >> np.uint64(56)
                bits |= np.where(ok, value, np.uint64(0)) << np.uint64(8 * i)
            sides[name] = bits.view(np.int64)
    far = np.searchsorted(lines, lines[np.maximum(0, pos - SPREAD + 1)] + LINES - 1, "left")
    near = np.searchsorted(lines, lines[np.minimum(n - 1, pos + GRAM + SPREAD - 2)] - LINES + 1, "right") - 1
    level = lambda need, reached: np.where(reached, np.searchsorted(LEVELS, need, "right"), TOO_FEW).astype(np.int8)
    return {
        "pos": pos.astype(np.int32), "h": mine.view(np.int64), "before": np.concatenate([none, link]).view(np.int64), "after": np.concatenate([link, none]).view(np.int64),
        **sides, "forth_n": level(far - pos + 1, far < n), "back_n": level(pos + GRAM - near, near >= 0),
    }


_SEED = {"pos": pa.int32(), "h": pa.int64(), "before": pa.int64(), "after": pa.int64(), "forth": pa.int64(), "back": pa.int64(), "forth_n": pa.int8(), "back_n": pa.int8()}


def _seeds(packed: DataFrame, group: str) -> DataFrame:
    """key (of group and gram), file and the columns of ``seeds_of``; a row per seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = []
                for p in part.column("tokens").to_pylist():
                    normal, _, lines = _unpack(p)
                    found.append(seeds_of(normal, lines, known))
                at = pa.array(np.repeat(np.arange(len(found)), [len(x["pos"]) for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(group).take(at), part.column("file").take(at), *[pa.array(np.concatenate([x[c] for x in found]), t) for c, t in _SEED.items()]], names=[group, "file", *_SEED])

    kinds = {"int8": "tinyint", "int32": "int", "int64": "bigint"}
    schema = T.StructType([packed.schema[group], T.StructField("file", T.LongType()), *T._parse_datatype_string(", ".join(f"{c} {kinds[str(t)]}" for c, t in _SEED.items())).fields])
    rows = packed.select(group, "file", "tokens").mapInArrow(run, schema)
    return rows.select(F.xxhash64(group, "h").alias("key"), "file", *[c for c in _SEED if c != "h"])


def _bucket(file, buckets: int):
    """Of a column or an array of files, the share of the tokens that they are in."""
    if isinstance(file, Column):
        return F.pmod(file.bitwiseXOR(F.shiftright(file, 33)), F.lit(buckets)).cast("int")
    return (file ^ (file >> 33)) % buckets


def _shrink(columns: Sequence[Sequence], kinds: str) -> bytes:
    """Columns of rows, compressed: whole numbers (i) byte by byte, other values (v) once each."""
    parts = []
    for c, kind in zip(columns, kinds):
        known: dict = {}
        numbers = np.array(c if kind == "i" else [known.setdefault(x, len(known)) for x in c], "<i8")
        parts.append((numbers.view(np.uint8).reshape(-1, 8).T.tobytes(), list(known)))
    whole = pickle.dumps(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _grow(blobs: Sequence[bytes]) -> list[np.ndarray]:
    """The columns of many ``_shrink``; other values as arrays of objects."""
    parts = [pickle.loads(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)) for b in blobs]  # noqa: S301 - written by _shrink
    columns = []
    for many in zip(*parts):
        found = []
        for raw, values in many:
            numbers = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
            if values:
                table = np.empty(len(values), object)
                table[:] = values
                numbers = table[numbers]
            found.append(numbers)
        columns.append(np.concatenate(found))
    return columns


def _sent(columns: Sequence[np.ndarray], kinds: str, buckets: int) -> pa.RecordBatch:
    """A row (b, rows) per bucket of the files in the first column, its rows in the order of their numbers."""
    to = _bucket(columns[0], buckets)
    order = np.lexsort([*[c for c, k in zip(columns[::-1], kinds[::-1]) if k == "i"], to])
    at = np.flatnonzero(np.diff(to[order], prepend=-1))
    parts = np.split(order, at[1:])
    return pa.RecordBatch.from_arrays([pa.array(to[order][at], pa.int32()), pa.array([_shrink([c[x] for c in columns], kinds) for x in parts], pa.binary())], names=["b", "rows"])


_SENT = "b int, rows binary"
#: Rows that are held until they are sent.
HELD = 100_000


def _columns(rows: list[tuple], kinds: str) -> list[np.ndarray]:
    out = []
    for c, kind in zip(zip(*rows), kinds):
        one = np.empty(len(rows), "<i8" if kind == "i" else object)
        one[:] = c
        out.append(one)
    return out


def _ends_sent(ends: DataFrame, buckets: int) -> DataFrame:
    """file, file2, shift, pos, opens, closes, sent to the bucket of the first file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns])
            n += batch.num_rows
            if n >= 10 * HELD:
                yield _sent([np.concatenate(c) for c in zip(*held)], "iiiiii", buckets)
                held, n = [], 0
        if n:
            yield _sent([np.concatenate(c) for c in zip(*held)], "iiiiii", buckets)

    return ends.select("file", "file2", "shift", "pos", "opens", "closes").mapInArrow(run, _SENT)


def _at_files(sent: DataFrame, packed: DataFrame, group: str, each: Callable, kinds: str, buckets: int, schema: str = _SENT, ready: Callable = lambda *columns: columns) -> DataFrame:
    """What was ``sent`` at the tokens of its bucket: each(file, group, path, normal, raw, lines, columns of its rows) gives rows.

    Rows of ``kinds`` are sent on to the bucket of their first file; without them they are rows of ``schema``. ``ready`` turns
    all columns of a bucket first. Only the rows of one bucket are held; the exchange of tokens is the same for every call.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        done: list[pa.RecordBatch] = []
        if not left.num_rows:
            return arrow.empty_table()
        columns = ready(*_grow(left.column("rows").to_pylist()))
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        files = right.column("file").to_numpy()
        where = dict(zip(files.tolist(), range(len(files))))
        starts = np.flatnonzero(np.diff(columns[0], prepend=columns[0][:1] - 1))
        out: list[tuple] = []

        def send() -> None:
            if kinds:
                done.append(_sent(_columns(out, kinds), kinds, buckets).cast(arrow))
            else:
                done.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow))

        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(columns[0])]):
            file = int(columns[0][s])
            i = where[file]
            g, path, tokens = [right.column(c)[i].as_py() for c in (group, "path", "tokens")]
            out += each(file, g, path, *_unpack(tokens), [c[s:e].tolist() for c in columns[1:]])
            if len(out) >= HELD:
                send()
                out = []
        if out:
            send()
        return pa.Table.from_batches(done, arrow)

    return sent.groupBy("b").cogroup(packed.groupBy("b")).applyInArrow(run, schema)


#: Slices of the groups that are worked on one after the other, at most, and bytes of packed tokens in one, at least.
SLICES, SLICE_BYTES = 8, 32 << 20
#: Files from which a group is large; its pairs come in slices of their first files, of about so many pairs of files.
LARGE_FILES, SLICE_PAIRS = 2000, 40_000_000


def _packed(tokens: DataFrame, group: str) -> DataFrame:
    file = F.col("rid") if "rid" in tokens.columns else F.xxhash64(group, "path")
    return tokens.filter(F.col(group).isNotNull() & F.col("path").isNotNull() & (F.length("tokens") > 0)).select(file.alias("file"), group, "path", "tokens")


def find_clones(tokens: DataFrame, group: str) -> DataFrame:
    """All pairs of equal blocks: clone_type (1 same text, 2 same structure), both line ranges, counts, checksum."""
    packed = _packed(tokens, group)
    spots = _seeds(packed, group)
    return _pairs(packed, spots, spots, group)


def store_clones(tokens: DataFrame, group: str, scratch: Scratch, columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``find_clones``, stored slice by slice, so that only the shuffles of one slice are there at a time.

    No pair leaves its group, so a slice is a share of the groups. Of the large groups, whose pairs grow with the square of
    their files, a slice holds the pairs of a share of their first files; their seeds are stored for that.
    """
    packed = _packed(tokens, group)
    sizes = packed.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(F.length("tokens")).alias("bytes"))
    sizes = scratch.write(sizes.withColumn("large", F.col("n") >= LARGE_FILES))
    few_bytes, pairs = sizes.agg(F.sum(F.when(~F.col("large"), F.col("bytes"))), F.sum(F.when(F.col("large"), F.col("n") * F.col("n") / 2))).first()
    large = F.broadcast(sizes.filter("large").select(group))  # at most a row per LARGE_FILES files

    def slices() -> Iterator[DataFrame]:
        n = min(SLICES, (few_bytes or 0) // SLICE_BYTES + 1)
        for k in range(n):
            part = packed.filter(F.pmod(F.xxhash64(group), F.lit(n)) == k).join(large, group, "left_anti")
            spots = _seeds(part, group)
            yield _pairs(part, spots, spots, group).select(*columns)
        if pairs:
            part = packed.join(large, group, "left_semi")
            spots, n = scratch.write(_seeds(part, group)), int(pairs // SLICE_PAIRS) + 1
            for k in range(n):
                yield _pairs(part, spots.filter(F.pmod(F.xxhash64("file"), F.lit(n)) == k), spots, group).select(*columns)
            scratch.drop(spots)

    blocks = scratch.gather(slices())
    scratch.drop(sizes)
    return blocks


def _pairs(packed: DataFrame, first: DataFrame, spots: DataFrame, group: str) -> DataFrame:
    """Blocks of the pairs whose first file has its seeds in ``first``, its second one in ``spots``."""
    size = packed.agg(F.count("*"), F.sum(F.length("tokens"))).first()
    buckets = max(4 * packed.sparkSession.sparkContext.defaultParallelism, size[0] // BUCKET_FILES, (size[1] or 0) // BUCKET_BYTES)
    own = [c for c in spots.columns if c != "key"]
    later = (F.col("file") < F.col("file2")) | ((F.col("file") == F.col("file2")) & (F.col("pos") < F.col("pos2")))
    edge = lambda c: (F.col(c) == 0) | (F.col(c) != F.col(f"{c}2"))

    def reaches(c: str):
        n = F.least(F.col(f"{c}_n"), F.col(f"{c}_n2")).cast("int")
        mask = F.expr(f"shiftleft(1L, 8 * cast(least({c}_n, {c}_n2) as int)) - 1L")
        return (n < TOO_FEW) & (F.col(c).bitwiseXOR(F.col(f"{c}2")).bitwiseAND(mask) == 0)

    # where both sides are the same rows, under the same names, they are made and shuffled once
    both = first.alias("l").join(spots.alias("r"), F.col("l.key") == F.col("r.key")).select(*[F.col(f"l.{c}").alias(c) for c in own], *[F.col(f"r.{c}").alias(f"{c}2") for c in own])
    ends = (
        both.filter(later & (edge("before") | edge("after")))
        .select("file", "file2", (F.col("pos2") - F.col("pos")).alias("shift"), "pos", (edge("before") & reaches("forth")).alias("opens"), (edge("after") & reaches("back")).alias("closes"))
        .filter("opens or closes")
    )
    kind = packed.schema[group].dataType.simpleString()
    final = f"{group} {kind}, clone_type int, source_file_path string, source_start_line int, source_end_line int, target_file_path string, target_start_line int, target_end_line int, token_count int, checksum string, line_count int"
    shared = packed.select(_bucket(F.col("file"), buckets).alias("b"), "file", group, "path", "tokens")
    near = _at_files(_ends_sent(ends, buckets), shared, group, _contexts, "iiiiivv", buckets, ready=_cores)
    exact = _at_files(near, shared, group, _extended, "ivviiiiiivv", buckets)
    return _at_files(exact, shared, group, _blocks, "", buckets, final)


def _cores(file, file2, shift, pos, opens, closes) -> list[np.ndarray]:
    """Both outer seeds of a run, which follow each other in (file, file2, shift) by pos.

    A run of LINES lines has both its ends here; what is paired without them is no run, which its tokens tell.
    """
    order = np.lexsort([pos, shift, file2, file])
    file, file2, shift, pos, opens, closes = [c[order] for c in (file, file2, shift, pos, opens, closes)]
    follows = np.append((file[1:] == file[:-1]) & (file2[1:] == file2[:-1]) & (shift[1:] == shift[:-1]), False)
    last = np.where(closes > 0, pos, np.append(pos[1:], 0))
    keep = (opens > 0) & ((closes > 0) | follows)
    return [c[keep] for c in (file, file2, shift, pos, last)]


def _digest(texts: list[str], a: int, n: int):
    return hashlib.sha256("\u0001".join(texts[a : a + n]).encode("utf-8", "surrogatepass"))


def _common(mine: list[str], other: list[str]) -> int:
    return next((k for k, (x, y) in enumerate(zip(mine, other)) if x != y), min(len(mine), len(other)))


def _contexts(file, g, path, normal: list[str], raw: list[str], lines: np.ndarray, rows: list[list]) -> list[tuple]:
    """What lies SPREAD tokens around the outer seeds of a run in its first file. No normal text holds a line end."""
    listed = functools.cache(lambda a, b: "".join(f"{t}\n" for t in normal[a:b]))
    return [(file2, file, shift, pos, last, listed(max(0, pos - SPREAD), pos), listed(last + GRAM, last + GRAM + SPREAD)) for file2, shift, pos, last in zip(*rows)]


def _extended(file2, g, path, normal: list[str], raw: list[str], lines: np.ndarray, rows: list[list]) -> list[tuple]:
    """Runs to their ends, with lines and digests of their second file."""
    out = []
    digests = functools.cache(lambda a, n: (_digest(normal, a, n).digest()[:16], _digest(raw, a, n).digest()[:16]))
    before = functools.cache(lambda a, ahead: _common(normal[max(0, a - SPREAD) : a][::-1], ahead.split("\n")[-2::-1]))
    after = functools.cache(lambda b, behind: _common(normal[b : b + SPREAD], behind.split("\n")[:-1]))
    for file, shift, pos, last, ahead, behind in zip(*rows):
        a, b = pos + shift, last + shift + GRAM
        i, j = before(a, ahead), after(b, behind)
        a, n = a - i, b - a + i + j
        # as far as SPREAD only from seeds at the margin of a run, whose inner seeds give it whole; a block that reaches into its own copy never counts
        if i < SPREAD and j < SPREAD and n >= WINDOW and (file != file2 or shift >= n):
            out.append((file, path, g, file == file2, shift, a - shift, n, int(lines[a]), int(lines[a + n - 1]), *digests(a, n)))
    return out


def _blocks(file, g, path, normal: list[str], raw: list[str], lines: np.ndarray, rows: list[list]) -> list[tuple]:
    """Blocks of all pairs that hold this file as their first: of those with the same begins the largest, without contained ones."""
    pairs: dict[str, dict] = {}
    digests = functools.cache(lambda a, n: (_digest(normal, a, n), _digest(raw, a, n).digest()[:16]))
    for path2, group2, same_file, shift, a, n, s2, e2, digest2, raw2 in zip(*rows):
        s, e = int(lines[a]), int(lines[a + n - 1])
        count = max(e - s, e2 - s2) + 1
        if count < LINES or group2 != g or (same_file and s2 <= e):
            continue
        checksum, mine = digests(a, n)
        if checksum.digest()[:16] != digest2:
            continue
        clone_type = 1 if mine == raw2 else 2
        here, there, seed = (path, s, e), (path2, s2, e2), a
        if path2 < path:
            here, there, seed = there, here, a + shift
        block, rank = (g, clone_type, *here, *there, n, checksum.hexdigest(), count), (-n, -count, clone_type, seed)
        known = pairs.setdefault(path2, {})
        if (at := (here[1], there[1])) not in known or rank < known[at][0]:
            known[at] = rank, block
    out = []
    for known in pairs.values():
        found = [known[at][1] for at in sorted(known)]
        source_end, target_start, target_end = np.array([[x[k] for x in found] for k in (4, 6, 7)])
        for i, x in enumerate(found):
            if not np.any((source_end[:i] >= x[4]) & (target_start[:i] <= x[6]) & (target_end[:i] >= x[7])):
                out.append(x)
    return out


def drop_contained(blocks: DataFrame, group: str) -> DataFrame:
    """Blocks that lie, on both sides, within an earlier block of the same two files go."""
    w = Window.partitionBy(group, "source_file_path", "target_file_path").orderBy("source_start_line", "target_start_line", F.desc("line_count"))
    ranked = blocks.withColumn("rk", F.row_number().over(w))
    a, o = ranked.alias("a"), ranked.alias("o")
    same = [F.col(f"a.{c}") == F.col(f"o.{c}") for c in (group, "source_file_path", "target_file_path")]
    inside = (F.col("o.rk") < F.col("a.rk")) & (F.col("o.source_start_line") <= F.col("a.source_start_line")) & (F.col("o.source_end_line") >= F.col("a.source_end_line"))
    inside = inside & (F.col("o.target_start_line") <= F.col("a.target_start_line")) & (F.col("o.target_end_line") >= F.col("a.target_end_line"))
    return a.join(o, same[0] & same[1] & same[2] & inside, "left_anti").drop("rk")


def covered_lines(blocks: DataFrame, group: str) -> DataFrame:
    """group, file_path, duplicated_lines: lines under the union of a file's blocks, either side."""
    side = lambda s: F.struct(F.col(f"{s}_file_path").alias("file_path"), F.col(f"{s}_start_line").alias("s"), F.col(f"{s}_end_line").alias("e"))
    ranges = blocks.select(group, F.explode(F.array(side("source"), side("target"))).alias("r")).select(group, "r.*").filter("s is not null and e is not null").distinct()
    w = Window.partitionBy(group, "file_path").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("opens", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    merged = fresh.withColumn("island", F.sum("opens").over(w)).groupBy(group, "file_path", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.groupBy(group, "file_path").agg(F.sum(F.col("e") - F.col("s") + 1).cast("long").alias("duplicated_lines"))


def duplication_ratio(duplicated: DataFrame, sloc: DataFrame, group: str) -> DataFrame:
    """Percent of source lines that are duplicated, at most 100; 0 without source lines."""
    d = duplicated.groupBy(group).agg(F.sum("duplicated_lines").alias("duplicated_lines"))
    out = sloc.groupBy(group).agg(F.sum("sloc").alias("sloc")).join(d, group, "left").withColumn("duplicated_lines", F.coalesce("duplicated_lines", F.lit(0)))
    return out.withColumn("duplication_ratio", F.when(F.col("sloc") > 0, F.round(F.least(F.lit(100.0), F.col("duplicated_lines") / F.col("sloc") * 100.0), 2)).otherwise(0.0))


def snippet(content, start, end):
    """The lines of a block, at most SNIPPET_LINES of them."""
    lines = F.split(content, "\n", -1)
    return F.array_join(F.slice(lines, start, F.least(end - start + 1, F.lit(SNIPPET_LINES))), "\n")
