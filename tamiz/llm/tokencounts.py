"""Token counts kept by deltas (operator 10).

A batch is a set of changes: an insert adds a document's tokens, a delete takes them away, a revision takes the old and
adds the new ones. Each is a signed row (source, lang, version, docs, tokens), as counts add up, and a batch is committed
as the sums of its rows by source, language and tokenizer version. Totals are the sums over all committed batches.

A commit is written beside and then renamed to a folder named after its batch, which takes effect at once or not at all: of
two writers of one batch the first wins, and what the second has written is dropped. A batch that is there is not committed
again, so a batch that is replayed, in whole or after a failure, counts once; a folder without Spark's _SUCCESS mark is not
read, and is replaced when its batch comes again. compact() puts the sums of all commits, and of the compaction before, into
one, with the names of the batches that it holds; it may run again and again. Only the last one that is complete counts.

Two tokenizer versions are counted: words apart by ASCII white space, and a public byte-level BPE vocabulary, whose path
is a parameter. A text's count is over the whole text; its pieces are counted once for each worker.

Defined cases: null and empty texts have 0 tokens and are counted as documents; null sources and languages are groups of
their own; repeated rows are documents of their own; deleting what was never inserted gives negative totals, which show
it; groups at zero documents and tokens are left out of the totals; an empty table gives an empty result; columns other
than doc_id, text, source and lang are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import stash

#: A folder with the public vocabulary files, and the one used here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text before byte pairs are merged, of the vocabulary's public description.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS, BPE = "words-1", "bpe50k-1"
ROLLUP = "source string, lang string, version string, docs long, tokens long"


@cache
def encoding(folder: str = TOKENIZERS, file: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer, read once for each worker process."""
    with open(f"{folder}/{file}", "rb") as f:  # the vocabulary is installed on each machine, beside the library
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, words, bpe) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = encoding(folder).encode_ordinary
            words, bpe = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                words.append(len(text.encode("utf-8", "surrogatepass").split()))
                # Long texts go through in pieces: a cut before a space that follows a letter is one that the pattern makes.
                n, at = 0, 0
                while len(text) - at > 100_000:
                    cut = at + 100_000
                    while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
                        cut += 1
                    n += len(encode(text[at:cut]))
                    at = cut
                bpe.append(n + len(encode(text[at:])))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(words, pa.int64()), pa.array(bpe, pa.int64())], names=["doc_id", "source", "lang", "words", "bpe"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return cols.mapInArrow(run, "doc_id long, source string, lang string, words long, bpe long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """counts(source, lang, words, bpe) as signed rows, one for each tokenizer version."""
    each = F.explode(F.array(F.struct(F.lit(WORDS).alias("version"), F.col("words").alias("t")), F.struct(F.lit(BPE).alias("version"), F.col("bpe").alias("t"))))
    return counts.select("source", "lang", each.alias("v")).select("source", "lang", "v.version", F.lit(sign).cast("long").alias("docs"), (F.col("v.t") * sign).alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals in a folder that all executors share, on a file system that renames a folder in one step."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, name: str) -> bool:
        return self.fs.exists(self._hadoop(f"{self.path}/{name}"))

    def _complete(self, kind: str) -> list[str]:
        """Names of the complete folders of a kind, batch or compact."""
        marks = self.fs.globStatus(self._hadoop(f"{self.path}/{kind}=*/_SUCCESS")) or []
        return sorted(m.getPath().getParent().getName().removeprefix(f"{kind}=") for m in marks)

    def _last(self) -> tuple[int, set[str]]:
        """The number of the last compaction, 0 if there is none, and the batches that it holds."""
        last = max(map(int, self._complete("compact")), default=0)
        if not last:
            return 0, set()
        return last, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/compact={last}/held").collect()}

    def batches(self) -> set[str]:
        """Names of all committed batches."""
        return set(self._complete("batch"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits signed rows (source, lang, version, docs, tokens) as this batch, unless it has been; whether it did."""
        place = f"batch={batch}"
        if self._exists(f"{place}/_SUCCESS"):
            return False
        own = f"_writing-{uuid.uuid4().hex}"  # hidden from readers, also within another's folder
        sums = changes.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.path}/{own}")
        if self._exists(place) and not self._exists(f"{place}/_SUCCESS"):
            self.fs.delete(self._hadoop(f"{self.path}/{place}"), True)
        done = self.fs.rename(self._hadoop(f"{self.path}/{own}"), self._hadoop(f"{self.path}/{place}"))
        late = f"{place}/{own}"  # where a folder goes that is renamed to one that is there
        for left in (late, own):
            if self._exists(left):
                self.fs.delete(self._hadoop(f"{self.path}/{left}"), True)
                done = False
        return bool(done)

    def _sums(self, last: int, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batch={b}" for b in batches] + ([f"{self.path}/compact={last}/sums"] if last else [])
        rows = self.spark.read.schema(ROLLUP).parquet(*paths) if paths else self.spark.createDataFrame([], ROLLUP)
        sums = rows.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches."""
        last, held = self._last()
        return self._sums(last, sorted(self.batches() - held))

    def compact(self) -> int:
        """Puts all commits into one, and gives its number. Until its mark is there the folders before it count, from then on
        they don't."""
        last, held = self._last()
        batches, new = self.batches(), last + 1
        done = f"{self.path}/compact={new}"
        self._sums(last, sorted(batches - held)).write.mode("overwrite").parquet(f"{done}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").write.mode("overwrite").parquet(f"{done}/held")
        self.fs.create(self._hadoop(f"{done}/_SUCCESS"), True).close()
        return new


def query(docs: DataFrame, path: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches and two replays, in a new folder.

    Batch 1 inserts every document with its words alone, as an older tokenizer would have it, batch 2 revises all counts,
    batch 3 deletes the documents of odd id, batch 4 inserts them again; batches 2 and 3 are replayed. The totals are those
    of all documents.
    """
    counts = stash(token_counts(docs), "counts")
    old = counts.withColumn("bpe", F.col("words"))
    odd = counts.where("doc_id % 2 = 1")
    rollup = Rollup(docs.sparkSession, path)
    rollup.commit("1", inserts(old))
    rollup.commit("2", revisions(old, counts))
    rollup.commit("3", deletes(odd))
    rollup.commit("2", revisions(old, counts))
    rollup.commit("4", inserts(odd))
    rollup.commit("3", deletes(odd))
    return rollup.totals()
