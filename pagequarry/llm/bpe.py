"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of at most ``chunk`` characters is encoded as it is. A longer one is cut into chunks that
overlap; the chunks are pre-tokenised in parallel, each from its own first character, and two
neighbours are stitched at the first position of the overlap where both have a pre-token
boundary: from there on both see the same text, so both go on alike. (The pattern looks ahead
but never back.) Where no boundary agrees, the stretch is pre-tokenised again from the last sure
boundary. The pieces between stitches are encoded in parallel and joined by document. Decoding
concatenates the bytes of the tokens.

A null text is an empty one. Rows are told apart by a row number made in the same pass, so repeated
or null ids do no harm. Special tokens are never made: their strings are ordinary text."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import map_text, tune

CHUNK = 1 << 16
OVERLAP = 1 << 10
_held: dict[str, "Codec"] = {}


class Codec:
    """Ranks and pattern of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.engine = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        size = max(ranks.values(), default=-1) + 1
        self.piece: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.piece[i] = b
        self.decimal = [str(i) for i in range(size)]

    def encode(self, text: str) -> list[int]:
        return self.engine.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def boundaries(self, text: str) -> np.ndarray:
        """Starts of the pre-tokens."""
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), np.int64)

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _codec(name: str, shared) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if name not in _held:
        _held.clear()
        _held[name] = Codec(*shared.value)
    return _held[name]


def sure_boundaries(starts: np.ndarray, visible: int, last: bool) -> np.ndarray:
    """Boundaries that what follows the visible text can't move."""
    return starts if last else starts[starts < visible - 1]


def stitch(codec: Codec, chunks: list[str], heads: list[np.ndarray], tails: list[np.ndarray], chunk: int, overlap: int) -> list[str]:
    """Pieces that start and end at pre-token boundaries of the whole text.

    chunks overlap their successor by overlap characters; heads has the boundaries in the first
    overlap characters of a chunk, tails those at chunk and after, less chunk. A piece never ends in
    white space: how a run of it is cut depends on what follows."""
    text = "".join(c[:chunk] for c in chunks)
    cuts, tail = [0], tails[0]
    for k in range(1, len(chunks)):
        both = [int(c) + k * chunk for c in np.intersect1d(tail, heads[k]) if not text[k * chunk + c - 1].isspace()]
        if both:
            cuts.append(both[0])
            tail = tails[k]
        else:
            seen = text[cuts[-1] : (k + 1) * chunk + overlap]
            own = sure_boundaries(codec.boundaries(seen), len(seen), k == len(chunks) - 1) + cuts[-1] - (k + 1) * chunk
            tail = own[(own >= 0) & (own < overlap)]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def encode_documents(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", output: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id with ids (array of int), or with output="digest" n_tokens, ids_sha256 and decoded_sha256,
    the last of the bytes that decoding gives back."""
    spark = df.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    id_type = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if output == "digest" else "ids array<int>"
    schema = f"doc_id {id_type}, {kinds}"

    def result(ids: pa.Array, found: list[list[int]], codec: Codec) -> pa.RecordBatch:
        if output == "digest":
            n, a, b = zip(*(codec.digests(x) for x in found))
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def whole(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(name, shared)
        return result(part.column("doc_id"), [codec.encode(t) for t in part.column("text").to_pylist()], codec)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, doc, t in zip(b["row"], b["doc_id"], b["text"]):
                for k in range(0, -(-len(t) // chunk)):
                    last = (k + 1) * chunk >= len(t)
                    part = t[k * chunk : (k + 1) * chunk + overlap]
                    yield pd.DataFrame({"row": [row], "doc_id": pd.Series([doc], dtype=b["doc_id"].dtype), "k": [k], "last": [last], "part": [part]})

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(name, shared)
        for b in batches:
            heads, tails = [], []
            for t, last in zip(b["part"], b["last"]):
                s = sure_boundaries(codec.boundaries(t), len(t), last)
                heads.append(s[s < overlap])
                tails.append(s[(s >= chunk) & (s < chunk + overlap)] - chunk)
            yield b.assign(head=heads, tail=tails)

    def join_chunks(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        pieces = stitch(_codec(name, shared), list(g["part"]), [np.asarray(x, np.int64) for x in g["head"]], [np.asarray(x, np.int64) for x in g["tail"]], chunk, overlap)
        return pd.DataFrame({"row": g["row"].iloc[0], "doc_id": pd.Series([g["doc_id"].iloc[0]] * len(pieces), dtype=g["doc_id"].dtype), "k": range(len(pieces)), "part": pieces})

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(name, shared)
        for b in batches:
            yield b[["row", "doc_id", "k"]].assign(ids=[np.array(codec.encode(t), np.int32).tobytes() for t in b["part"]])

    def join_pieces(g: pa.Table) -> pa.Table:
        g = g.sort_by("k")
        ids = np.concatenate([np.frombuffer(x, np.int32) for x in g.column("ids").to_pylist()]).tolist()
        return pa.Table.from_batches([result(g.column("doc_id").combine_chunks().slice(0, 1), [ids], _codec(name, shared))])

    long = F.octet_length("text") > chunk
    short = map_text(rows.where(~long), whole, schema)
    parts = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInPandas(cut, f"row long, doc_id {id_type}, k long, last boolean, part string")
    parts = parts.repartition("row", "k").mapInPandas(pretokenise, f"row long, doc_id {id_type}, k long, last boolean, part string, head array<long>, tail array<long>")
    pieces = parts.groupBy("row").applyInPandas(join_chunks, f"row long, doc_id {id_type}, k long, part string")
    coded = pieces.repartition("row", "k").mapInPandas(encode_pieces, f"row long, doc_id {id_type}, k long, ids binary")
    return short.unionByName(coded.groupBy("row").applyInArrow(join_pieces, schema))


def decode_documents(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary), the bytes of its ids one after another; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    @F.pandas_udf("binary")
    def decode(column: pd.Series) -> pd.Series:
        codec = _codec(name, shared)
        return column.map(lambda x: None if x is None else codec.decode([int(i) for i in x]))

    return df.withColumn("decoded", decode(F.col(ids)))


@lru_cache(1)
def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers as P

    return load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN
