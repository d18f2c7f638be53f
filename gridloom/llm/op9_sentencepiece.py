"""SentencePiece encoding and decoding through a table of distinct marked chunks.

No piece of the model holds a whitespace marker after another character, so no
piece crosses the start of a run of markers, and a text's ids are the ids of its
chunks (a run of markers and what follows up to the next run) put side by side.
Each task keeps a table from chunk to ids and decoded text. What a batch holds
and the table lacks is segmented once by the library, and then the ids are
joined back by position. The table is emptied when it holds `table_chars`
characters, which changes no result.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KINDS = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
_loaded: dict = {}


class ChunkTable:
    """Keys are chunks without their first marker; markers are spaces here."""

    def __init__(self, path: str, table_chars: int = 6_000_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        bad = [p for p in map(self.sp.id_to_piece, range(self.sp.vocab_size())) if MARK in p.lstrip(MARK)]
        if bad or any(p.startswith(MARK * 2) and p.strip(MARK) for p in map(self.sp.id_to_piece, range(self.sp.vocab_size()))):
            raise ValueError(f"pieces of {path} cross whitespace markers: the chunk table would not be exact")
        if self.sp.encode("a  b ") != self.sp.encode("a") + self.sp.encode(" b") + [self.sp.piece_to_id(MARK)]:
            raise ValueError(f"{path} normalises white space: the chunk table would not be exact")
        self.limit, self.held = table_chars, 0
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.begin, self.end = (array("I", [x]).tobytes() for x in (self.sp.bos_id(), self.sp.eos_id()))

    def keys(self, text: str) -> list[str]:
        """The chunks of a text, in order. The library puts one marker before a text that isn't empty, and takes the marker itself for a space."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(r" +[^ ]*", f" {text}")]

    def learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.ids]
        if self.held > self.limit:
            self.ids, self.text, self.held, new = {}, {}, 0, list(keys)
        self.held += sum(map(len, new))
        for k, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            self.ids[k] = array("I", ids or [self.sp.piece_to_id(MARK)]).tobytes()
            self.text[k] = self.sp.decode(ids)

    def encode(self, keys: list[str]) -> bytes:
        return b"".join([self.begin, *map(self.ids.__getitem__, keys), self.end])

    def decode(self, keys: list[str]) -> str:
        return " ".join(map(self.text.__getitem__, keys))


def _table(path: str, table_chars: int) -> ChunkTable:
    if path not in _loaded:
        _loaded[path] = ChunkTable(path, table_chars)
    return _loaded[path]


def encode_decode(docs: DataFrame, model: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded"), key: str = "doc_id", text: str = "text", table_chars: int = 6_000_000) -> DataFrame:
    """Rows (key, *outputs), one for each row of docs.

    outputs: of ids (with begin and end ids), decoded, n_tokens, ids_sha256,
    decoded_sha256. A null text counts as empty: its ids are begin and end. Repeated
    rows give repeated rows; other columns of docs are ignored; an empty table gives
    an empty one.
    """
    path = model or public_tokenizers.path(MODEL)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema[key], *(T.StructField(x, T._parse_datatype_string(KINDS[x])) for x in outputs)])

    def run(batches):
        t = _table(path, table_chars)
        for b in batches:
            texts = b.column(1)
            cells: dict[str, list] = {x: [] for x in outputs}
            at = 0
            while at < len(texts):
                keys, chars = [], 0
                while at < len(texts) and chars < 4_000_000:
                    s = texts[at].as_py()
                    chars += len(s)
                    keys.append(t.keys(s))
                    at += 1
                t.learn(set().union(*keys))
                for k in keys:
                    ids = t.encode(k)
                    if "n_tokens" in cells:
                        cells["n_tokens"].append(len(ids) // 4)
                    if "ids" in cells:
                        cells["ids"].append(array("I", ids).tolist())
                    if "ids_sha256" in cells:
                        cells["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    if "decoded" in cells:
                        cells["decoded"].append(t.decode(k))
                    if "decoded_sha256" in cells:
                        cells["decoded_sha256"].append(hashlib.sha256(t.decode(k).encode()).hexdigest())
            types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cells[x], types.get(x, pa.string())) for x in outputs)], [key, *outputs])

    return rows.mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
