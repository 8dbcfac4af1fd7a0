"""Catalogues: a table of products with the columns that searches read, from CSV files or from any DataFrame."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tamiz.functions.backends import Embedding, Encoder
from tamiz.functions.once import let

# The columns of a catalogue file, bound by their names in the header.
CSV_COLUMNS = ("id_codigo", "descripcion_articulo", "descripcion_larga_art", "unidad_medida", "ultimo_precio", "activo")
#: Where a catalogue file is looked for when no path is given, after the environment variable.
CSV_VARIABLE, CSV_PATHS = "CATALOGO_CSV_PATH", ("catalogo.csv", "../catalogo.csv", "data/catalogo.csv")


@dataclass(frozen=True)
class Catalog:
    """rows(row_idx long, id string, name string, long_name string, active int): row_idx is the catalogue order.

    Columns that searches derive from the rows are made once each; keep() holds those in use in memory, and on disk
    where memory ends. encoder and backend are those of phonetic and cosine search.
    """

    rows: DataFrame
    encoder: Encoder = Encoder()
    backend: Embedding = Embedding()

    @cached_property
    def tokens(self) -> DataFrame:
        from tamiz.functions.text import word_tokens

        return self.rows.withColumn("tokens", word_tokens(F.col("name")))

    @cached_property
    def shingles(self) -> DataFrame:
        from tamiz.functions.text import bigram_shingles

        return self.rows.withColumn("shingles", bigram_shingles(F.col("long_name")))

    @cached_property
    def codes(self) -> DataFrame:
        """(row_idx, id, name, pri, sec): the phonetic index."""
        return self.rows.select("row_idx", "id", "name", self.encoder.codes(F.col("name")).alias("c")).select("row_idx", "id", "name", "c.pri", "c.sec")

    @cached_property
    def vectors(self) -> DataFrame:
        """(name, vec): embeddings of the different names."""
        return self.rows.select("name").distinct().withColumn("vec", self.backend.of(F.col("name")))

    @cached_property
    def spelt(self) -> DataFrame:
        """The different names with what edit search reads of them: the index of edit search."""
        from tamiz.operators.edit import indexed

        return indexed(self.rows.select("name").distinct())

    @cached_property
    def first_names(self) -> DataFrame:
        """(id, first_name): the name of the first row of each id."""
        return self.rows.groupBy("id").agg(F.min_by("name", "row_idx").alias("first_name"))

    def keep(self, *derived: str) -> Catalog:
        """Caches the rows, or the derived tables named: they are then computed once."""
        for name in derived or ("rows",):
            getattr(self, name).persist()
        return self

    def drop(self) -> None:
        for name in ("rows", *(k for k in self.__dict__ if isinstance(self.__dict__[k], DataFrame))):
            getattr(self, name).unpersist()

    def count(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def insert(self, other: Catalog) -> Catalog:
        """Both catalogues' rows, those of the other behind."""
        top = self.rows.agg((F.coalesce(F.max("row_idx"), F.lit(-1)) + 1).alias("top"))
        moved = other.rows.join(F.broadcast(top)).withColumn("row_idx", F.col("row_idx") + F.col("top")).drop("top")  # one row
        return replace(self, rows=self.rows.unionByName(moved))


def from_dataframe(df: DataFrame, id: str, name: str, long_name: str | None = None, active: Column | None = None, order: str | None = None) -> Catalog:
    """A catalogue of a table. order: a column of unique whole numbers, the catalogue order; else rows are numbered as read."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    flag = F.lit(1) if active is None else active.cast("int")
    return Catalog(df.select(number.alias("row_idx"), text(id).alias("id"), text(name).alias("name"), text(long_name or name).alias("long_name"), flag.alias("active")))


def csv_path(path: str | None = None) -> str | None:
    """The path given, or that of the environment variable, or the first default file that is there."""
    return path or os.environ.get(CSV_VARIABLE) or next((p for p in CSV_PATHS if os.path.exists(p)), None)


def load_csv(spark: SparkSession, path: str | None = None) -> Catalog | None:
    """The catalogue of a CSV file with a header; None if there is no such file.

    Columns are bound by name; rows without a whole number in `activo`, or with too few or too many fields, are dropped. Empty
    fields are empty strings. Prices stay text.
    """
    path = csv_path(path)
    if path is None:
        return None
    try:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
        columns = reader.csv(path).columns
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if missing := [c for c in CSV_COLUMNS if c not in columns]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    # A row of more or fewer fields than the header has is malformed: then the last column holds it.
    kind = StructType([StructField(c, StringType()) for c in [*columns, "malformed row"]])
    raw = reader.schema(kind).option("columnNameOfCorruptRecord", "malformed row").csv(path).where("`malformed row` is null")
    raw = raw.withColumn("n", F.monotonically_increasing_id()).select("n", *CSV_COLUMNS)
    good = raw.where(F.trim("activo").rlike(r"\A[+-]?[0-9]+\z") & F.expr("try_cast(trim(activo) AS int)").isNotNull())
    return from_dataframe(good, "id_codigo", "descripcion_articulo", "descripcion_larga_art", F.expr("try_cast(trim(activo) AS int)"), "n")


def attributes(df: DataFrame, sku: str, words: list[str]) -> DataFrame:
    """(row_idx, sku, attributes): codes with their bitmaps of 64-bit words."""
    return df.select(F.monotonically_increasing_id().alias("row_idx"), F.col(sku).alias("sku"), F.array(*[F.col(w).cast("long") for w in words]).alias("attributes"))


def vectors(df: DataFrame, label: str, vec: str, dim: int, order: str | None = None) -> DataFrame:
    """(row_idx, label, vec): labelled vectors; an error for one of another length."""
    right = F.assert_true(F.size(vec) == dim, F.lit(f"a vector must have {dim} components")).isNull()
    number = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    return df.select(number.alias("row_idx"), F.col(label).cast("string").alias("label"), F.when(right, F.col(vec).cast("array<float>")).alias("vec"))


#: Vocabulary of the generated catalogues: things and what is said of them.
THINGS = "llave tubo cable broca rodillo lámpara sensor válvula correa filtro bisagra perno junta motor tapa".split()
KINDS = "corta larga fina gruesa plana doble roja azul blanca liviana reforzada estándar".split()


def _choice(words: list[str], of: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(of, F.lit(len(words))).cast("int"))


def misspelt(name: Column, rnd: Column) -> Column:
    """A name with one slip at a place that rnd decides: a letter lost, doubled, swapped with the next, or changed."""

    def slip(x: Column) -> Column:
        at = (F.pmod(F.shiftrightunsigned(rnd, 8), F.greatest(F.char_length(x) - 1, F.lit(1))) + 1).cast("int")
        part = lambda a, n: F.substring(x, a, n)
        head, here, after, tail = part(F.lit(1), at - 1), part(at, F.lit(1)), part(at + 1, F.lit(1)), part(at + 2, F.char_length(x))
        ways = [F.concat(head, after, tail), F.concat(head, here, here, after, tail), F.concat(head, after, here, tail), F.concat(head, _choice(list("aeiorstln"), F.shiftrightunsigned(rnd, 20)), after, tail)]
        return F.get(F.array(*ways), F.pmod(rnd, F.lit(4)).cast("int"))

    return let(name, slip)


def synthetic(spark: SparkSession, n: int, slips: float = 0.5, seed: int = 1) -> Catalog:
    """A catalogue of n products for load tests: names of a small vocabulary with a number, a share of them with a slip.
    The same n and seed give the same rows."""
    rnd = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    plain = F.concat_ws(" ", _choice(THINGS, rnd(1)), _choice(KINDS, rnd(2)), (F.pmod(rnd(3), F.lit(97)) + 3).cast("string"))
    slipped = F.pmod(rnd(4), F.lit(1000)) < int(slips * 1000)
    label = let(plain, lambda x: F.when(slipped, misspelt(x, rnd(5))).otherwise(x))
    rows = spark.range(n).withColumn("label", label).withColumn("code", F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 8, "0")))
    return from_dataframe(rows, "code", "label", order="id")


def synthetic_sounds(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(row_idx, plain, heard): names, and how they may be written by ear: letters that sound alike in one another's place."""
    rows = synthetic(spark, n, 0.0, seed).rows
    heard, rnd = F.col("name"), F.xxhash64("row_idx", F.lit(seed), F.lit(9))
    for i, (a, b) in enumerate([("v", "b"), ("qu", "k"), ("c", "k"), ("z", "s"), ("ll", "y"), ("h", "")]):
        heard = F.regexp_replace(heard, F.lit(a), F.when(F.shiftrightunsigned(rnd, i).bitwiseAND(F.lit(1)) == 1, b).otherwise(a))
    return rows.select("row_idx", F.col("name").alias("plain"), heard.alias("heard"))


def synthetic_vectors(spark: SparkSession, n: int, dim: int, clusters: int = 8, spread: float = 0.2, seed: int = 1) -> DataFrame:
    """(row_idx, label, vec): unit vectors around random centers; label is the center's number."""

    def run(batches):
        centers = np.random.default_rng(seed).normal(size=(clusters, dim))
        for df in batches:
            noise = np.stack([np.random.default_rng([seed, int(i)]).normal(size=dim) for i in df["id"]]) if len(df) else np.zeros((0, dim))
            v = centers[df["id"].to_numpy() % clusters] + spread * noise
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            df = df.assign(label=(df["id"] % clusters).astype(str), vec=list(v.astype(np.float32)))
            yield df.rename(columns={"id": "row_idx"})[["row_idx", "label", "vec"]]

    return spark.range(n).mapInPandas(run, "row_idx long, label string, vec array<float>")
