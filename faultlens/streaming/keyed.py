"""Repository rows kept as state of the stream: the newest version of a file wins.

Two stateful operators, one behind the other. The first is keyed by repository and a
hash of the path; it keeps the facts of every file that stands, and tells the second
what changed: counts of labels, flags, languages and libraries that went up or down,
and its first labelled file. The second is keyed by repository, adds the changes up and
gives out a row for each repository that changed. So a micro-batch costs what it brings,
not what the store holds; a repository with a third of all files is spread over
``parts`` keys, and its own key sees a few rows from each.

A file is named by repository and path. A version that is older than the one that
stands, or equal to it, changes nothing, in whichever batch it comes; of two contents
with one version the greater digest stands. Results in special cases: a file without a
path is named by its digest; a null version is older than all; rows without a repository
belong to none and are left out; an empty batch changes nothing.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from faultlens.operators.relational import latest_wins
from faultlens.operators.signals import canonical_flags, classify_files
from faultlens.session import checkpoint_dir
from faultlens.shipping import ship_package

PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 32

CHANGES = "repo_url string, part int, counts string, first_path string, first_label string, changed boolean"
RESULTS = """repo_url string, total_files long, failed_files long, handled_files long, exception_type string,
languages array<string>, http_libraries array<string>, resilience_libraries array<string>,
flags map<string, long>, parser_success_rate double"""

_LISTS = {"flag": "flags", "http": "http_libraries", "resilience": "resilience_libraries"}


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep state in RocksDB, which these operators need; the
    given session's settings stay as they are."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set(PROVIDER_SETTING, PROVIDER)
    return session


def _counted(facts: dict) -> list[str]:
    """What a file counts for."""
    names = ["total"]
    if facts["failed"]:
        names.append("failed")
    elif facts["label"] != "None":
        names += ["handled", "label:" + facts["label"]]
    if facts["language"] is not None:
        names.append("language:" + facts["language"])
    return names + [f"{kind}:{name}" for kind, column in _LISTS.items() for name in facts[column]]


def _first(files: dict[str, dict]) -> tuple[str, str] | tuple[None, None]:
    labelled = [p for p, f in files.items() if not f["failed"] and f["label"] != "None"]
    path = min(labelled, default=None)
    return (path, files[path]["label"]) if path is not None else (None, None)


class _Files(StatefulProcessor):
    """The files that stand, of one repository and part."""

    def init(self, handle) -> None:
        self.files = handle.getMapState("files", "path string", "facts string")
        self.first = handle.getValueState("first", "path string, label string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        newest: dict[str, tuple] = {}
        for frame in rows:
            for path, version, digest, facts in zip(frame["path"], frame["version"], frame["digest"], frame["facts"]):
                given = (-(1 << 63) if pd.isna(version) else int(version), digest, facts)
                if path not in newest or given[:2] > newest[path][:2]:
                    newest[path] = given
        counts, before = Counter(), self.first.get() if self.first.exists() else (None, None)
        first, gone = tuple(before), False
        for path, (version, digest, facts) in newest.items():
            stands = json.loads(self.files.getValue((path,))[0]) if self.files.containsKey((path,)) else None
            if stands and (version, digest) <= (stands["version"], stands["digest"]):
                continue
            now = {**json.loads(facts), "version": version, "digest": digest}
            counts.update(_counted(now))
            if stands:
                counts.subtract(_counted(stands))
            self.files.updateValue((path,), (json.dumps(now),))
            if path == first[0]:
                gone = True
            found = _first({path: now})
            if found[0] is not None and (first[0] is None or found[0] <= first[0]):
                first, gone = found, False
        if gone:  # the first labelled file lost its label: look for the next
            first = _first({k[0]: json.loads(v[0]) for k, v in self.files.iterator()})
        if first != tuple(before):
            self.first.update(first)
        counts = {name: n for name, n in counts.items() if n}
        if counts or first != tuple(before):
            yield pd.DataFrame({
                "repo_url": [key[0]], "part": [key[1]], "counts": [json.dumps(counts)],
                "first_path": [first[0]], "first_label": [first[1]], "changed": [True]})

    def close(self) -> None:
        pass


class _Repository(StatefulProcessor):
    """Sums over the parts of one repository."""

    def init(self, handle) -> None:
        self.counts = handle.getValueState("counts", "counts string")
        self.firsts = handle.getMapState("firsts", "part int", "path string, label string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        counts = Counter(json.loads(self.counts.get()[0])) if self.counts.exists() else Counter()
        for frame in rows:
            for part, changes, path, label in zip(
                    frame["part"], frame["counts"], frame["first_path"], frame["first_label"]):
                counts.update(json.loads(changes))
                if path is not None and not pd.isna(path):
                    self.firsts.updateValue((int(part),), (path, label))
                elif self.firsts.containsKey((int(part),)):
                    self.firsts.removeKey((int(part),))
        counts = Counter({name: n for name, n in counts.items() if n})
        self.counts.update((json.dumps(counts),))
        first = min((tuple(v) for _, v in self.firsts.iterator()), default=(None, "None"))[1]
        both = counts["label:Basic"] and counts["label:Advanced"]
        names = defaultdict(dict)
        for name, n in counts.items():
            kind, _, rest = name.partition(":")
            names[kind][rest] = n
        total, failed = counts["total"], counts["failed"]
        yield pd.DataFrame({
            "repo_url": [key[0]], "total_files": [total], "failed_files": [failed],
            "handled_files": [counts["handled"]],
            "exception_type": ["Mixed" if first != "None" and both else first],
            **{column: [sorted(names[kind])] for kind, column in (
                ("language", "languages"), ("http", "http_libraries"), ("resilience", "resilience_libraries"))},
            "flags": [names["flag"]], "parser_success_rate": [(total - failed) / total if total else 0.0]})

    def close(self) -> None:
        pass


def _facts(signals: DataFrame) -> Column:
    """A file's facts as JSON; of a failed file only its language and libraries count."""
    analysed = F.col("parse_status") != "failed"
    nothing = F.array().cast("array<string>")
    readable = F.coalesce("decode_ok", F.lit(True)) if "decode_ok" in signals.columns else F.lit(True)
    lists = {
        "flags": F.when(analysed, canonical_flags(F.col("flags"))).otherwise(nothing),
        **{c: F.col(c) if c in signals.columns else nothing for c in ("http_libraries", "resilience_libraries")}}
    return F.to_json(F.struct(
        (~analysed).alias("failed"), F.when(analysed, F.col("label")).otherwise("None").alias("label"),
        F.when(readable, F.col("language")).alias("language"),
        *(F.array_sort(F.array_distinct(F.coalesce(c, nothing))).alias(name) for name, c in lists.items())),
        {"ignoreNullFields": "false"})


def keyed_rows(files: DataFrame, version: Column, parts: int = PARTS, **classify) -> DataFrame:
    """A stream of files to a stream of repository rows, one whenever a repository changes.
    ``files`` belongs to a ``stateful_session``; ``version`` orders a file's deliveries."""
    spark = files.sparkSession
    if spark.conf.get(PROVIDER_SETTING, None) != PROVIDER:
        raise ValueError(f"state is kept in RocksDB: read the stream in stateful_session(spark) ({PROVIDER_SETTING})")
    ship_package(spark)
    signals = classify_files(files.withColumn("version", version.cast("long")), **classify)
    slim = signals.where(F.col("repo_url").isNotNull()).select(
        "repo_url", "path", "version", _facts(signals).alias("facts")
    ).withColumn("digest", F.sha2("facts", 256))
    named = slim.withColumn("path", F.coalesce("path", F.concat(F.lit("\u0000"), "digest")))
    keyed = named.withColumn("part", F.pmod(F.hash("path"), F.lit(parts)))
    changes = keyed.groupBy("repo_url", "part").transformWithStateInPandas(
        _Files(), CHANGES, "Append", "None")
    return changes.groupBy("repo_url").transformWithStateInPandas(_Repository(), RESULTS, "Append", "None")


def start_keyed_scan(files: DataFrame, store: str, version: Column, checkpoint: str | None = None,
                     parts: int = PARTS, **classify) -> StreamingQuery:
    """Process everything available, then stop. Each batch writes the rows that changed into
    a folder of its own, so a replayed batch replaces what it wrote."""
    import hashlib

    name = hashlib.sha1(store.rstrip("/").encode()).hexdigest()[:16]
    location = checkpoint or f"{checkpoint_dir(files.sparkSession)}/keyed-scan-{name}"

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch_id={int(batch_id)}")

    return (
        keyed_rows(files, version, parts, **classify).writeStream.foreachBatch(store_batch)
        .outputMode("append").option("checkpointLocation", location).trigger(availableNow=True).start()
    )


def keyed_results(spark: SparkSession, store: str) -> DataFrame:
    """The newest row of each repository: rows of repositories are read, never of files."""
    stored = spark.read.option("basePath", store).schema(f"{RESULTS}, batch_id long").parquet(store)
    return latest_wins(stored.drop("flags"), "repo_url", "batch_id").join(
        latest_wins(stored.select("repo_url", "batch_id", F.map_entries("flags").alias("flags")),
                    "repo_url", "batch_id").select("repo_url", F.map_from_entries("flags").alias("flags")),
        "repo_url").drop("batch_id")
