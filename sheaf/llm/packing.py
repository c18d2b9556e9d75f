"""Best-fit packing with certified bin counts.

Documents become token ids and an end id; only those longer than a sequence are cut. Pieces fall
into partitions by hash, and each partition is packed best-fit decreasing. Dual-feasible functions
bound from below how many sequences its pieces need; a partition that needs no fewer is certified.
The others give up the sequences that aren't full; these pieces mix in new partitions and are
packed again, as long as that saves sequences.

Defined results: a null or empty text is a document of its end id alone; repeated rows are packed
each, and so are rows without a doc_id; ties in length go by doc_id, then piece; an empty table gives an empty
result. The input's other columns are ignored. A partition's pieces, a few numbers each, are what one task holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import scratch, written
from ._text import SPACE, Texts, chunks, texts_of

#: Texts with a longer run of white space or of other bytes go to the slower library, whose time doesn't grow with the square of it. Both give the same ids: see _same_merges.
LONG_RUN = 400
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("gap", pa.bool_())])
PACKED_SQL = PIECE_SQL + ", sequence_id long, offset long, fill long, gap boolean"


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(2)
def _ranked(path: str):
    """The same byte-level vocabulary in the faster library, or None where it isn't one that both read alike."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in chars} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(chars))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    places = [spec["model"]["vocab"]["".join(m)] for m in merges]
    if places != sorted(places) or any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    if not _same_merges(ranks, [tuple(bytes(byte[c] for c in x) for x in m) for m in merges]):
        return None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _same_merges(ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> bool:
    """Whether joining any two symbols whose bytes are a token, lowest token first, is the same as following the list of merges.

    Symbols that stand side by side and make token t have joined nothing outside, so within t they went as t alone
    would. So it is enough that each token alone, by the tokens before it, ends as the pair that its merge names.
    """
    if len({a + b for a, b in merges}) != len(merges) or {a + b for a, b in merges} != {t for t in ranks if len(t) > 1}:
        return False
    for a, b in merges:
        token = a + b
        limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
            if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if parts != [a, b]:
            return False
    return True


def _longest_run(texts: Texts) -> np.ndarray:
    """An upper bound for each text's longest run of white space or of other bytes: a run within it is cut nowhere."""
    if not len(texts.data):
        return np.zeros(len(texts), np.int64)
    turn = np.flatnonzero(np.diff(SPACE[texts.data].astype(np.int8))) + 1
    edges = np.unique(np.concatenate([[0], turn, texts.bounds]))
    edges = edges[edges < len(texts.data)]
    size = np.diff(np.append(edges, len(texts.data)))
    out = np.zeros(len(texts), np.int64)
    np.maximum.at(out, np.searchsorted(texts.bounds, edges, side="right") - 1, size)
    return out


def token_ids(path: str, column: pa.Array) -> Iterator[np.ndarray]:
    """The ids that the tokenizers library gives for each text, special strings as it handles them."""
    fast = _ranked(path)
    runs = _longest_run(texts_of(column))
    for text, run in zip(column.to_pylist(), runs):
        if fast is not None and run <= LONG_RUN:
            yield fast.encode_to_numpy(text or "", allowed_special="all")
        else:
            yield np.array(_tokenizer(path).encode(text or "", add_special_tokens=False).ids, np.uint32)


def cut_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: where it starts, how long it is, and a checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 4 << 20, 20_000):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), token_ids(path, part.column(1))):
                    ids = np.append(ids, end_id).astype("<u4")
                    head = (len(ids) - 1) % size + 1
                    ends = [*range(head, len(ids) + 1, size)]
                    at = 0
                    for k, to in enumerate(ends):
                        rows.append((doc_id, k, at, to - at, zlib.crc32(ids[at:to])))
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SQL)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences needed at least: the best of the dual-feasible functions u_k, for k up to 20, and U_e, for every length e that can matter."""
    if not len(lengths):
        return 0
    values, counts = np.unique(lengths, return_counts=True)
    best = -(-int((values * counts).sum()) // size)
    for k in range(1, 21):
        # u_k(x) = x where (k + 1) x is whole, else floor((k + 1) x) / k
        whole = (k + 1) * values % size == 0
        scaled = np.where(whole, values * k, (k + 1) * values // size * size)
        best = max(best, -(-int((scaled * counts).sum()) // (size * k)))
    for e in np.unique(np.concatenate([values[values <= size // 2], [0]])):
        scaled = np.where(values > size - e, size, np.where(values < e, 0, values))
        best = max(best, -(-int((scaled * counts).sum()) // size))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length. lengths must not rise."""
    bins = np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms, made = 0, 0  # a bit for each room that some bin has
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            room, b, made = size, made, made + 1
        bins[i] = b
        if left := room - n:
            open_at[left].append(b)
            rooms |= 1 << left
    return bins


def _pack(size: int, base: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
        n = rows.column("length").to_numpy()
        bins = best_fit_decreasing(n, size)
        fill = np.bincount(bins, weights=n).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(n[order])
        heads = np.concatenate([[True], np.diff(bins[order]) > 0])
        before = (ends - n[order])[heads]
        offset = np.empty(len(n), np.int64)
        offset[order] = ends - n[order] - np.repeat(before, np.diff(np.append(np.flatnonzero(heads), len(n))))
        gap = len(fill) > lower_bound(n, size)
        more = {"sequence_id": (base + key[0].as_py() << 32) + bins, "offset": offset, "fill": fill[bins], "gap": np.full(len(n), gap)}
        return pa.Table.from_arrays([*(rows.column(f.name).combine_chunks().cast(f.type) for f in PIECE), *(pa.array(v) for v in more.values())], schema=PACKED)

    return run


def pack(pieces: DataFrame, size: int = 2048, per_partition: int = 1 << 25, most_rounds: int = 4) -> DataFrame:
    """pieces with sequence_id and offset. pieces should be a written table, since it is read several times.

    per_partition: tokens that a partition holds at most on average (and 100,000 pieces)."""

    def spread(rows: DataFrame, tokens: int, count: int, turn: int) -> DataFrame:
        n = max(1, -(-tokens // per_partition), -(-count // 100_000))
        keyed = rows.select(*PIECE.names).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(n)))
        return written(keyed.groupBy("part").applyInArrow(_pack(size, turn << 24), PACKED_SQL), "packed")

    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    if not total[1]:
        return pieces.select(*PIECE.names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = spread(pieces, total[0], total[1], 0)
    for turn in range(1, most_rounds + 1):
        loose = packed.where(F.col("gap") & (F.col("fill") < size))
        found = loose.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*"), F.count_if(F.col("offset") == 0), F.count_distinct(F.shiftright("sequence_id", 32))).first()
        if found[3] < 2:  # nobody to exchange with
            break
        again = spread(loose, found[0], found[1], turn)
        if again.where("offset = 0").count() >= found[2]:
            break
        packed = packed.where(~(F.col("gap") & (F.col("fill") < size))).unionByName(again)
    return packed.select(*PIECE.names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    with scratch() as keep:
        return keep(written(pack(written(cut_pieces(docs, path, size, end_id), "pieces"), size), "sequences"))
