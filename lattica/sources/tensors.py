"""Tensor files in the safetensors layout: an 8-byte little-endian header length, a JSON header, then the data.

Files are read by Spark's own `binaryFile` source, so any path, list or glob that Spark can open will do; each file is
one row, decoded in the task that holds it (files of up to 2 GB, Spark's bound for a row: checkpoints come in such shards).
For larger files on a mount that all executors see, the "safetensors" data source makes each tensor an input partition and reads its bytes alone.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..graph import Graph
from .files import write_bytes

SCHEMA = "name string, dtype string, shape array<int>, data array<double>"
#: The format's names of element types.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?", "BF16": "<u2"}


def read_header(path: str) -> tuple[dict, int]:
    with open(path, "rb") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        header = json.loads(f.read(n))
    header.pop("__metadata__", None)
    return header, 8 + n


def decode(raw: bytes, dtype: str) -> np.ndarray:
    a = np.frombuffer(raw, KINDS[dtype])
    return (a.astype("<u4") << 16).view("<f4") if dtype == "BF16" else a


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        header, base = read_header(self.path)
        return [InputPartition((name, h["dtype"], h["shape"], base + h["data_offsets"][0], h["data_offsets"][1] - h["data_offsets"][0])) for name, h in sorted(header.items())]

    def read(self, partition):
        name, dtype, shape, at, size = partition.value
        with open(self.path, "rb") as f:
            f.seek(at)
            yield name, dtype, list(shape), decode(f.read(size), dtype).astype(float).tolist()


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls):
        return "safetensors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("content"):
            raw = memoryview(blob.as_buffer())
            (n,) = struct.unpack("<Q", raw[:8])
            header = json.loads(bytes(raw[8 : 8 + n]))
            for name, h in sorted(header.items()):
                if name != "__metadata__":
                    a, b = (8 + n + x for x in h["data_offsets"])
                    data = decode(bytes(raw[a:b]), h["dtype"]).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([h["dtype"]]), pa.array([h["shape"]], pa.list_(pa.int32())), pa.array([data], pa.list_(pa.float64()))], ["name", "dtype", "shape", "data"])


def read_safetensors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, dtype, shape, data) of all tensors in the files."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_tensors, SCHEMA)


def read_large_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """As read_safetensors(), of one file of any size on a mount that the driver and all executors see."""
    spark.dataSource.register(SafetensorsSource)
    return spark.read.format("safetensors").option("path", path).load()


def write_safetensors(tensors: DataFrame, path: str) -> None:
    """One file of F32 tensors (name, shape, data); the rows are streamed through the driver one at a time."""
    rows = tensors.select("name", "shape", F.size("data").alias("n")).orderBy("name").collect()
    header, at = {}, 0
    for r in rows:
        header[r.name] = {"dtype": "F32", "shape": list(r.shape), "data_offsets": [at, at + 4 * r.n]}
        at += 4 * r.n
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)

    def parts() -> Iterator[bytes]:
        yield struct.pack("<Q", len(text)) + text
        for r in tensors.orderBy("name").select("data").toLocalIterator():
            yield np.array(r.data, "<f4").tobytes()

    write_bytes(tensors.sparkSession, path, parts())


def operator_graph(tensors: DataFrame) -> Graph:
    """A vertex (id, label, kind, layer, part, shape, data) for each tensor, in order of name, and edges along the model.

    Within a layer its parts follow each other in order of name; the last of a layer leads to the first of the next, the tensors
    before all layers (embeddings) to the first layer, the last layer to what comes after (final norm, head).  Weights stay at their vertices.
    """
    from pyspark.sql import Window

    columns = layer_of()
    rows = tensors.withColumns(columns).withColumn("kind", operator_kind())
    late = F.col("name").rlike(r"^(model\.)?norm|lm_head")
    rows = rows.withColumn("stage", F.when(F.col("layer").isNotNull(), F.col("layer") + 1).when(late, F.lit(1 << 30)).otherwise(0))
    # one row a tensor: a table of names, of a few thousand rows, is ranked whole
    order = Window.orderBy("stage", "name")
    ranked = rows.select("name", "stage", F.row_number().over(order).alias("id")).withColumn("id", F.col("id") - 1)
    rows = rows.join(ranked.select("name", "id"), "name")
    v = rows.select(F.col("id").cast("long").alias("id"), F.lit(1).alias("gen"), F.col("name").alias("label"), "kind", "layer", "part", "shape", "data")
    e = ranked.select(F.col("id").cast("long").alias("src"), F.lead("id").over(order).cast("long").alias("dst"), "stage", F.lead("stage").over(order).alias("next"))
    e = e.where("dst IS NOT NULL").select(F.col("src").alias("edge_id"), "src", "dst", F.lit(1.0).alias("weight"), F.when(F.col("stage") == F.col("next"), "Sequence").otherwise("Layer").alias("kind"))
    return Graph(v, e)


def load_operator_graph(spark: SparkSession, path: str | list[str]) -> Graph:
    return operator_graph(read_safetensors(spark, path))


def save_operator_graph(graph: Graph, path: str) -> None:
    """The vertices' weights (label, shape, data) as F32."""
    write_safetensors(graph.vertices.select(F.col("label").alias("name"), "shape", "data"), path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def layer_of(name: str = "name") -> dict:
    """Columns layer (null outside layers) and part of a weight's name."""
    return {"layer": F.expr(f"try_cast(nullif(regexp_extract({name}, 'layers\\\\.(\\\\d+)\\\\.', 1), '') as int)"), "part": F.when(F.col(name).rlike(r"layers\.\d+\."), F.regexp_extract(name, r"layers\.\d+\.(.*)$", 1)).otherwise(F.col(name))}


def operator_kind(name: str = "name"):
    """Operator inferred from a weight's name."""
    n = F.lower(F.col(name))
    return F.when(n.rlike("attn|attention|q_proj|k_proj|v_proj|o_proj"), "Attention").when(n.rlike("mlp|ffn|gate_proj|up_proj|down_proj"), "MLP").when(n.rlike("norm|ln_"), "Norm").when(n.rlike("embed|wte"), "Embedding").when(n.rlike("lm_head|linear|proj"), "Linear").otherwise("Custom")
