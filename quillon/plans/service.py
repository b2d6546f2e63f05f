"""The service over stored tables: what an application calls, without a server, and a small command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import answers, rules
from quillon.plans import clients, pipelines, questions


@dataclass
class Service:
    """Stored documents, chunks with vectors and relations, and the model services that answer over them."""

    metadata: DataFrame
    chunks: DataFrame
    relations: DataFrame
    embedder: Callable[[], clients.Embedder] = clients.HashEmbedder
    reranker: Callable[[], clients.Reranker] = clients.OverlapReranker
    generator: Callable[[], clients.Generator] | None = None

    def chat(self, asked: DataFrame, key: str, text: str) -> DataFrame:
        """An answer with its sources to each question."""
        if self.generator is None:
            raise ValueError("the service has no generator")
        return pipelines.answer(asked, key, text, self.chunks, self.generator, embedder=self.embedder, reranker=self.reranker)

    def documents(self, offset: int = 0, limit: int = 50) -> DataFrame:
        """A page of the documents."""
        return self.metadata.orderBy("meta_id").offset(offset).limit(limit)

    def search(self, asked: DataFrame, key: str) -> DataFrame:
        return questions.find_documents(asked, key, self.metadata)

    def relation_types(self) -> list[str]:
        return sorted({*rules.RELATION_OF.values(), *rules.SHOWN_RELATIONS.values()})

    def replace(self, new_metadata: DataFrame, new_chunks: DataFrame, replacements: DataFrame) -> Service:
        """The service after new documents; relation types may be given as they are shown."""
        coded = replacements.withColumn("relation_type", rules.relation_code(F.col("relation_type")))
        meta, held, related = pipelines.replace_documents(self.metadata, self.chunks, self.relations, new_metadata, new_chunks, coded)
        return Service(meta, held, related, self.embedder, self.reranker, self.generator)

    def stats(self) -> DataFrame:
        """Rows of each store."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("store"), "rows")
        return count(self.metadata, "documents").unionByName(count(self.chunks, "chunks")).unionByName(count(self.relations, "relations"))


def benchmark(asked: DataFrame, key: str, service: Service, way: str = "tagged", truth: str = "truth") -> tuple[DataFrame, DataFrame]:
    """Each question with the letter that the service's answer chose, and the share of right ones.

    Questions have ``instruction``, ``question``, ``answers`` and the right letter.  A
    question without an answer counts as wrong.
    """
    texts = asked.withColumn("_text", answers.question_text(F.col("instruction"), F.col("question"), F.col("answers")))
    said = service.chat(texts, key, "_text")
    judged = asked.select(key, truth).join(said.select(F.col("query").alias("_q"), "answer"), F.col(key) == F.col("_q"), "left").drop("_q")
    judged = judged.withColumn("predicted", answers.WAYS[way](F.col("answer"))).withColumn("right", F.col("predicted") == F.upper(F.trim(truth)))
    share = judged.agg(F.count(F.lit(1)).alias("questions"), F.count_if("right").alias("right"))
    return judged, share.withColumn("accuracy", F.try_divide(F.col("right").cast("double"), F.col("questions")))


def main(argv: list[str] | None = None) -> int:
    """``python -m quillon.plans.service query NAME DIR`` shows a query's rows, ``list`` names the queries, ``stats DIR`` counts the stores."""
    from quillon.io import table
    from quillon.plans import catalog
    from quillon.session import build_session

    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    query = commands.add_parser("query")
    query.add_argument("name", choices=sorted(catalog.QUERIES))
    query.add_argument("folder")
    query.add_argument("--rows", type=int, default=20)
    commands.add_parser("stats").add_argument("folder")
    given = parser.parse_args(argv)
    if given.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark: SparkSession = SparkSession.getActiveSession() or build_session()
    if given.command == "query":
        shown, rows = catalog.QUERIES[given.name](spark, given.folder), given.rows
    else:
        shown, rows = Service(*(table(spark, given.folder, n) for n in ("document_metadata", "document_node", "document_relation"))).stats(), 10
    for row in shown.limit(rows).toJSON().collect():
        print(json.dumps(json.loads(row), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
