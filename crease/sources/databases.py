"""One Spark database per ``db_id``.

A question set names the database its statements are written for. Each is a database of the session catalog, whose tables are
views over the data, so an unqualified table name in a statement means that database's table. A session of its own
per database holds the current-database setting; sessions share the catalog, the cluster and nothing else.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

from crease.operators.queryset import schema_text
from crease.session import checkpoint_dir

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Settings that a session of its own takes over from the session it is made from.
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold",
         "spark.sql.ansi.enabled")


def create_database(spark: SparkSession, db_id: str, tables: Mapping[str, str]) -> None:
    """Database ``db_id`` with a view per table, given as query text; an existing database gets the views anew."""
    if not all(_NAME.fullmatch(n) for n in (db_id, *tables)):
        raise ValueError(f"not a database or table name among {[db_id, *tables]}")
    # The folder stays empty, as views hold no data; it is named because the default lies where the driver was started.
    folder = f"{checkpoint_dir(spark).rstrip('/')}/databases/{db_id}-{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db_id} LOCATION '{folder}'")
    for name, query in tables.items():
        spark.sql(f"CREATE OR REPLACE VIEW {db_id}.{name} AS {query}")


def database_present(spark: SparkSession, db_id: str) -> bool:
    return _NAME.fullmatch(db_id or "") is not None and spark.catalog.databaseExists(db_id)


def session_for(spark: SparkSession, db_id: str) -> SparkSession:
    """A session whose current database is ``db_id``."""
    own = spark.newSession()
    for key in _KEPT:
        own.conf.set(key, spark.conf.get(key))
    own.catalog.setCurrentDatabase(db_id)
    return own


def database_schemas(spark: SparkSession, db_ids: list[str]) -> list[tuple[str, str]]:
    """(db_id, table definitions or an error text) as a question's context."""
    return [(d, schema_text(spark, d) if database_present(spark, d) else f"Error reading schema: no database {d}") for d in db_ids]
