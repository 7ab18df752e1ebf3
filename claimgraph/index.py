"""The search index of a store: postings, lengths and vectors as tables beside its log.

Records never change once they are written, so the index only grows: it is extended by the log's
new records, and a question reads no text that was read before. A log that was rewritten, as a
redaction does, makes the index anew. An index of one model is refused to another.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.operators import lexical, vectors
from claimgraph.store import Ledger, Refused

POSTING = "term string, record_id string, seq long, passage int, length int, tf long"
LENGTH = "record_id string, passage int, length int"
VECTOR = "record_id string, window int, content_hash long, vector array<double>"


class SearchIndex:
    """``passage_tokens``: tokens of a passage, None for whole texts. It is fixed when the index is made, and so
    are the embedder's model and windows."""

    def __init__(self, ledger: Ledger, embedder: vectors.Embedder | None = None, passage_tokens: int | None = None):
        self.ledger, self.embedder = ledger, embedder or vectors.hashing_embedder()
        self.shape = {"model": self.embedder.model_id, "window": self.embedder.window, "passage": passage_tokens}
        self.path = f"{ledger.path}/index"

    def state(self) -> dict:
        """``seq``: the last record that is in; ``log``: the batches it was made from; ``parts``: its own."""
        try:
            with open(f"{self.path}/state.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"shape": self.shape, "seq": -1, "log": [], "parts": []}

    def advance(self) -> int:
        """Take in what the log has beyond the index; the number of its parts that are new (0 or 1)."""
        state, log = self.state(), self.ledger.batches()
        if state["shape"] != self.shape:
            raise Refused(f"the index is of {state['shape']}, not of {self.shape}")
        if state["log"] != log[: len(state["log"])]:
            self.drop()
            state = self.state()
        if state["log"] == log:
            return 0
        fresh = self.ledger.records.where(F.col("seq") > state["seq"]).select("record_id", "seq", "refs", "text")
        part = f"{len(state['parts']):06d}"
        index = lexical.TextIndex(fresh, self.shape["passage"])
        for name, rows in (("postings", index.all_postings), ("lengths", index.lengths), ("vectors", self.embedder.embedded(fresh))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/part={part}")
        # What a crash leaves behind has no place in the state and is written over.
        with open(f"{self.path}/state.tmp", "w") as f:
            json.dump({"shape": self.shape, "seq": self.ledger.last()["seq"], "log": log, "parts": [*state["parts"], part]}, f)
            f.flush()
            os.fsync(f.fileno())
        os.rename(f"{self.path}/state.tmp", f"{self.path}/state.json")
        return 1

    def drop(self) -> None:
        shutil.rmtree(self.path, ignore_errors=True)

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/part={p}" for p in self.state()["parts"]]
        spark = self.ledger.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def texts(self) -> lexical.TextIndex:
        return lexical.TextIndex.stored(self.ledger.records, self._table("postings", POSTING), self._table("lengths", LENGTH))

    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTOR)

    def similar(self, questions: DataFrame, shown: DataFrame) -> DataFrame:
        """``query_id, record_id, similarity`` of the records in ``shown`` (record_id), each by its best window."""
        docs = self.vectors().join(shown.select("record_id"), "record_id", "left_semi").withColumnRenamed("record_id", "key")
        asked = questions.select("query_id", self.embedder.query(F.col("text")).alias("vector"))
        found = vectors.exact_similar(docs, asked, self.embedder.dims, unique=self.embedder.window is None)
        return found.withColumnRenamed("key", "record_id")
