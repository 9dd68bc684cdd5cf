"""Asking a classifier slice by slice: a bounded number of calls at a time, cancelled between or within slices, resumed.

classify.call() asks in as many tasks as Spark runs at once. Here the prompts are written to a folder first, in slices of
consecutive ranks. A lane is a thread of the driver that runs one job of one task after the other, a slice each; so no
more calls are under way than there are lanes, and the pause between two calls holds for a lane. What a slice's job has
written stays whatever happens later. A row has an answer or it is asked on the next call of resume(); an answer that
says that a call failed is an answer, one that says that a row was not asked is none. If an executor is lost within a
slice, Spark asks that slice again.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .classify import Classifier, Options, call, stub


@dataclass(frozen=True)
class Outcome:
    state: str  # done, cancelled, or broken: too many failures in a row
    answered: int  # rows, in all calls of resume()
    left: int


class Asking:
    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.tag = f"asking-{uuid.uuid4().hex}"
        self._stop = threading.Event()

    def _has(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def prepare(self, prompts: DataFrame, rank: str = "rang", rows: int = 50) -> "Asking":
        """Write prompts (key, prompt, and a rank from 1) in slices of so many ranks, unless they are there already.
        Keys are distinct and not null."""
        if not self._has("prompts/_SUCCESS"):
            dealt = prompts.select(self.key, "prompt", F.col(rank).cast("long").alias("rank"), F.floor((F.col(rank) - 1) / rows).cast("long").alias("slice"))
            dealt.select(self.key).limit(0).write.mode("overwrite").parquet(f"{self.folder}/key")
            dealt.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{self.folder}/prompts")
        return self

    @cached_property
    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/key").schema[self.key].dataType.simpleString()

    def _read(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self._kind}, {columns}, slice long").parquet(f"{self.folder}/{name}")

    def _own(self, name: str, number: int, columns: str) -> DataFrame:
        """Of one slice, whose folder alone is listed: a listing of all, once a slice, would grow with the square of the rows."""
        return self.spark.read.schema(f"{self.key} {self._kind}, {columns}").option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}/slice={number}")

    def _prompts(self) -> DataFrame:
        return self._read("prompts", "prompt string, rank long")

    def _answers(self) -> DataFrame:
        try:
            return self._read("answers", "reply string, erreur string")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            none = F.lit(None).cast("string")
            return self._prompts().where("false").select(self.key, none.alias("reply"), none.alias("erreur"), "slice")

    def answers(self) -> DataFrame:
        """key, reply and erreur of the rows that were asked so far; see classify.verdicts()."""
        return self._answers().drop("slice")

    def pending(self) -> DataFrame:
        """The prompts that have no answer yet."""
        had = self._answers().select("slice", self.key).hint("merge")  # as many as rows: not through the driver
        return self._prompts().join(had, ["slice", self.key], "left_anti")

    def cancel(self, now: bool = False) -> None:
        """Take no more slices. now: those under way are interrupted and lose their answers; otherwise they are finished."""
        self._stop.set()
        if now:
            self.spark.interruptTag(self.tag)

    def _ask(self, number: int, classifier: Classifier, options: Options) -> bool:
        """Ask what is left of a slice. False if rows were left out after too many failures."""
        left = self._own("prompts", number, "prompt string, rank long")
        if self._has(f"answers/slice={number}"):
            left = left.join(self._own("answers", number, "reply string, erreur string").select(self.key).hint("merge"), self.key, "left_anti")
        left = left.coalesce(1).sortWithinPartitions("rank")
        skipped = Observation()
        found = call(left, classifier, options, self.key).observe(skipped, F.count_if(F.col("erreur") == "interrupted").alias("n"))
        found.where("erreur is null or erreur <> 'interrupted'").write.parquet(f"{self.folder}/answers/slice={number}/{uuid.uuid4().hex}")
        return skipped.get["n"] == 0

    def resume(self, classifier: Classifier = stub, options: Options = Options(), lanes: int = 4, on_slice: Callable[[int], None] = lambda done: None) -> Outcome:
        """Ask for all rows that have no answer, lanes slices at a time, in the order of ranks. on_slice hears how many
        slices are done; it may cancel. Returns when no lane is busy."""
        self._stop.clear()
        numbers = self.pending().select("slice").distinct().orderBy("slice").toLocalIterator()
        lock, done, troubles, broken = threading.Lock(), [0], [], threading.Event()

        def slices() -> Iterator[int]:
            while not self._stop.is_set():
                with lock:
                    row = next(numbers, None)
                if row is None:
                    return
                yield row.slice

        def lane() -> None:
            self.spark.addTag(self.tag)
            try:
                for number in slices():
                    if not self._ask(number, classifier, options):
                        broken.set()
                        self._stop.set()
                    with lock:
                        done[0] += 1
                        on_slice(done[0])
            except Exception as e:
                if not self._stop.is_set():  # an interrupted job is no trouble
                    troubles.append(e)
                    self._stop.set()
            finally:
                self.spark.removeTag(self.tag)

        threads = [InheritableThread(target=lane) for _ in range(lanes)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if troubles:
            raise troubles[0]
        left = self.pending().count()
        return Outcome("broken" if broken.is_set() else "cancelled" if left else "done", self.answers().count(), left)
