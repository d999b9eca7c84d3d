"""Rule files: YAML policies, JSON rule lists, and rules as a DataFrame.

A policy is configuration: a short document that is read when a plan is built.
With a session given, paths go through Spark and may name any file system that
the cluster knows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from maskframe.policy import MaskPolicy, Rule

try:
    import yaml
except ImportError:  # JSON is a subset of YAML, so JSON policies still load.
    yaml = None

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_idx", T.LongType(), False),
        T.StructField("table", T.StringType(), True),
        T.StructField("column", T.StringType(), False),
        T.StructField("strategy", T.StringType(), False),
    ]
)


def _read(path: str, spark: SparkSession | None) -> str:
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    return spark.read.text(path, wholetext=True).first()[0]


def _write(text: str, path: str, spark: SparkSession | None) -> None:
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    # One file on whatever file system the path names.
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _parse(text: str):
    if yaml is None:
        try:
            return json.loads(text)
        except ValueError as e:
            raise ValueError(f"not a JSON policy, and YAML needs the yaml package: {e}") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not a policy document: {e}") from e


def load_policy(path: str, spark: SparkSession | None = None) -> MaskPolicy:
    """Read a policy; a wrong document raises ``ValueError``."""
    return MaskPolicy.from_dict(_parse(_read(path, spark)))


def save_policy(policy: MaskPolicy, path: str, spark: SparkSession | None = None) -> None:
    raw = policy.to_dict()
    _write(
        json.dumps(raw, indent=2) if yaml is None else yaml.safe_dump(raw, sort_keys=False),
        path,
        spark,
    )


#: What an unusable file leads to: it is not there, cannot be read, or is not a policy.
UNUSABLE = (OSError, ValueError, TypeError, KeyError, AttributeError, PySparkException, Py4JJavaError)


def reload(
    policy: MaskPolicy,
    path: str,
    spark: SparkSession | None = None,
    on_result: Callable[[MaskPolicy, Exception | None], None] | None = None,
) -> MaskPolicy:
    """The policy in the file, or the one in force if the file is not usable.

    ``on_result`` is told of every reload: the policy that is in force from now on, and
    the error that kept the old one.
    """
    try:
        found, error = load_policy(path, spark), None
    except UNUSABLE as e:
        found, error = policy, e
    if on_result is not None:
        on_result(found, error)
    return found


def reload_audit(spark: SparkSession, before: MaskPolicy, now: MaskPolicy, error: Exception | None) -> DataFrame | None:
    """The audit row of a reload: refused, or changed; None if the file says what it said before."""
    from maskframe.operators.audit import audit_row, config_reload

    if error is not None:
        said = str(error).strip().splitlines()[0][:500] if str(error).strip() else type(error).__name__
        return audit_row(spark, "config_reload", "failure", details={"rules_count": len(now.rules)}, error=said)
    return config_reload(spark, len(now.rules)) if now != before else None


def export_rules(
    policy: MaskPolicy, path: str | None = None, spark: SparkSession | None = None
) -> str:
    """Rules as a JSON list; also written to ``path`` if given."""
    text = json.dumps([r.to_dict() for r in policy.rules], indent=2)
    if path is not None:
        _write(text, path, spark)
    return text


def import_rules(
    policy: MaskPolicy, path: str, spark: SparkSession | None = None
) -> MaskPolicy:
    """Append the rules of a JSON list; duplicates are kept."""
    raw = json.loads(_read(path, spark))
    if not isinstance(raw, list):
        raise ValueError("a rule file is a JSON list")
    return policy.extend(Rule.from_dict(r) for r in raw)


def rules_df(spark: SparkSession, policy: MaskPolicy) -> DataFrame:
    """Rules with their position, for joins with findings or a catalog."""
    rows = [(i, r.table, r.column, r.strategy) for i, r in enumerate(policy.rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)
