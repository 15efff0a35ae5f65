"""Token ids as Re-Pair grammars, one per shard.

A shard is a run of whole documents, in the order of the table's files, of
about SHARD_TOKENS token ids. In it, frequent pairs of neighbouring ids are
replaced by new ids (nonterminals), round after round, until no pair is left
that occurs twice. A round replaces many pairs at once: where occurrences of
two pairs overlap, the pair of greater count has it, and a pair is only taken
in a round in which at least two occurrences are left to it. The pair of
greatest count always keeps all of its own, so every round makes progress. A
pair of two equal ids is taken on the same terms; inside a run of that id it is
counted and replaced left to right without overlap. Pairs never cross a
document's end. A shard stores its rules, the expansion length of every
nonterminal, the reduced sequence and where each document starts in ids and in
symbols, so any range of a document's ids is decoded without expanding the rest.

Shards are made inside the scan's partitions: the text is never shuffled, and a
lost task rebuilds the same shards. A shard is named by its partition and its
place in it, which no two of a table share.

Defined results for odd input:

* null or empty text: a document of no ids; null doc_id: stored, id null;
* very long text: whole, in a shard of its own if it is longer than one;
* ties between pairs: the smaller pair code; repeated rows: stored each;
* special-token strings in a text: ordinary text;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm import tokens as bpe
from tarifold.llm.common import table

VOCABULARY, IDS = "byte_bpe_50k", 50_257
SHARD_TOKENS = 1 << 20
#: Least count of a replaced pair.
MIN_COUNT = 2

_LOW = 0xFFFFFFFF

SCHEMA = "shard string, doc_ids array<bigint>, id_starts array<int>, symbol_starts array<int>, rules binary, lengths binary, symbols binary, n_ids bigint, n_symbols bigint, n_rules int"


def _alternate(at: np.ndarray) -> np.ndarray:
    """Which of the rising positions are the first, third, fifth ... of their run of neighbours."""
    nth = np.arange(len(at))
    head = np.ones(len(at), bool)
    head[1:] = at[1:] != at[:-1] + 1
    return (nth - np.maximum.accumulate(np.where(head, nth, 0))) % 2 == 0


def _ordered(pair: np.ndarray, at: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the pairs at the rising positions in rising order, and the position of each; number bounds the ids.

    Where two ids and a position fit in 63 bits they are sorted as one integer,
    which takes a fraction of the time of an indirect sort.
    """
    codes = pair[at]
    wide, room = int(number).bit_length(), len(pair).bit_length()
    if 2 * wide + room > 63:
        order = np.argsort(codes, kind="stable")
        return codes[order], at[order]
    packed = codes >> 32
    packed <<= wide
    codes &= _LOW
    packed |= codes
    packed <<= room
    packed |= at
    packed.sort()
    place = packed & ((1 << room) - 1)
    packed >>= room
    codes = packed >> wide
    codes <<= 32
    packed &= (1 << wide) - 1
    codes |= packed
    return codes, place


def compress(ids: np.ndarray, starts: np.ndarray, first: int = IDS, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol starts, rules, lengths) of the documents that start at starts.

    rules[k] is the pair that nonterminal first + k stands for, lengths[k] the
    number of ids it expands to. A pair's code is the 8 bytes of two
    neighbouring 4-byte ids, read in place.

    live marks the positions whose pair may still be frequent: the count of a
    pair never rises once both its symbols exist, so a position that was rare
    stays so until one of its two symbols is replaced. Later rounds therefore
    sort few positions only.
    """
    seq = np.ascontiguousarray(ids, "<i4")
    begins = np.zeros(len(seq) + 1, bool)
    begins[starts] = True
    live = np.ones(len(seq), bool)
    rules, lengths, number = [], np.ones(first + len(seq), np.int64), first
    while len(seq) > 1:
        pair = np.ndarray((len(seq) - 1,), "<i8", seq, 0, (4,))
        inside = live[:-1] & ~begins[1:-1]
        twins = np.flatnonzero((seq[:-1] == seq[1:]) & ~begins[1:-1])
        inside[twins[~_alternate(twins)]] = False  # overlaps the pair before it
        at = np.flatnonzero(inside)
        if not len(at):
            break
        ordered, place = _ordered(pair, at, number)
        edge = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(np.append(edge, len(ordered)))
        often = counts >= min_count
        keep = np.repeat(often, counts)
        live[place[~keep]] = False
        if not often.any():
            break
        code, counts = ordered[edge[often]], counts[often]
        # a pair's rank: falling count, then code; of two overlapping occurrences the better ranked is replaced
        rank = np.empty(len(code), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(code), dtype=np.int32)
        own = np.full(len(seq) + 1, len(code), np.int32)
        own[place[keep]] = np.repeat(rank, counts)
        at = np.flatnonzero(own < len(code))
        mine = own[at]
        best = (mine <= own[at + 1]) & ((mine < own[at - 1]) | (at == 0))
        at, mine = at[best], mine[best]
        enough = np.bincount(mine, minlength=len(code)) >= min_count
        left_to = enough[mine]
        at, mine = at[left_to], mine[left_to]
        chosen = np.flatnonzero(enough[rank])
        name = np.zeros(len(code), np.int32)
        name[rank[chosen]] = np.arange(number, number + len(chosen))
        code = code[chosen]
        left, right = code & _LOW, code >> 32
        rules.append(np.column_stack([left, right]))
        lengths[number : number + len(chosen)] = lengths[left] + lengths[right]
        number += len(chosen)
        seq[at] = name[mine]
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        kept = np.flatnonzero(stay)
        seq, live, begins = seq[kept], live[kept], np.append(begins[kept], begins[-1])
    _, nth = np.unique(starts, return_inverse=True)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq, np.flatnonzero(begins)[nth], made, lengths[first:number]


def decode(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int = 0, stop: int | None = None, first: int = IDS) -> np.ndarray:
    """Ids start to stop of the symbols' expansion; only symbols that overlap it are expanded."""
    sizes = np.ones(len(symbols), np.int64)
    rule = symbols >= first
    sizes[rule] = lengths[symbols[rule] - first]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.int64)
    lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
    part, skipped = symbols[lo : hi + 1].astype(np.int64), int(ends[lo] - sizes[lo])
    while (rule := part >= first).any():
        width = np.where(rule, 2, 1)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[at] = part
        out[at[rule]], out[at[rule] + 1] = rules[part[rule] - first, 0], rules[part[rule] - first, 1]
        part = out
    return part[start - skipped : stop - skipped]


def read_document(row: dict, position: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of the document at a position of a stored shard."""
    symbols = np.frombuffer(row["symbols"], np.int32)
    bounds = [*row["symbol_starts"], len(symbols)]
    rules = np.frombuffer(row["rules"], np.int32).reshape(-1, 2)
    return decode(symbols[bounds[position] : bounds[position + 1]], rules, np.frombuffer(row["lengths"], np.int32), start, stop)


def _shard_row(name: str, doc_ids: list, parts: list[np.ndarray]) -> dict:
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    symbols, at, rules, lengths = compress(ids, starts)
    return {
        "shard": name, "doc_ids": doc_ids, "id_starts": starts.astype(np.int32).tolist(), "symbol_starts": at.astype(np.int32).tolist(),
        "rules": rules.astype(np.int32).tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "symbols": symbols.astype(np.int32).tobytes(), "n_ids": len(ids), "n_symbols": len(symbols), "n_rules": len(rules),
    }


def shards(docs: DataFrame, folder: str = bpe.VOCABULARY_DIR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard, with its grammar and its documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(VOCABULARY, folder)
        shape = pa.schema([
            ("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("id_starts", pa.list_(pa.int32())), ("symbol_starts", pa.list_(pa.int32())), ("rules", pa.binary()), ("lengths", pa.binary()),
            ("symbols", pa.binary()), ("n_ids", pa.int64()), ("n_symbols", pa.int64()), ("n_rules", pa.int32()),
        ])
        doc_ids, parts, size, partition, place = [], [], 0, TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(enc, text.as_py()) if text.is_valid else np.zeros(0, np.uint32)
                if size and size + len(ids) > shard_tokens:
                    yield pa.RecordBatch.from_pylist([_shard_row(f"{partition}-{place}", doc_ids, parts)], shape)
                    doc_ids, parts, size, place = [], [], 0, place + 1
                doc_ids.append(doc_id)
                parts.append(ids)
                size += len(ids)
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_shard_row(f"{partition}-{place}", doc_ids, parts)], shape)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the grammars of all shards of the documents table."""
    return shards(table(spark, sf_dir, "documents"))
