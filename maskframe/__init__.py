"""Find and mask personal data in Spark tables and streams."""

from maskframe.functions.detect import (
    contains_pii,
    is_json,
    is_scannable,
    looks_like_json,
    looks_like_pg_array,
    name_pii_type,
    pii_type,
    strategy_of,
)
from maskframe.functions.nested import leaf_scan, mask_json, mask_nested, mask_pg_array, mask_text
from maskframe.functions.partial import mask_sample, partial, preview, quick
from maskframe.functions.prose import (
    holds_personal_data,
    mask_prose,
    prose_log,
    prose_scan,
    redact_text,
    token_scan,
)
from maskframe.functions.sql import register_functions
from maskframe.functions.strategies import mask_value, register_strategy, strategy_names
from maskframe.operators.asof import as_of, mask_as_of
from maskframe.operators.bucket import token_bucket
from maskframe.operators.discover import (
    ScanConfig,
    findings,
    profile,
    scan,
    scan_summary,
    type_breakdown,
)
from maskframe.operators.mask import (
    change_log,
    mask,
    mask_sql,
    masking_counters,
    masking_counters_wide,
    observed,
)
from maskframe.operators.paths import scan_paths
from maskframe.operators.rules import resolved_rules_df, rules_summary, suggest_rules, uncovered
from maskframe.policy import AuditConfig, HealthConfig, LimitsConfig, MaskPolicy, Rule, resolve_rules
from maskframe.sources.policy_io import (
    export_rules,
    import_rules,
    load_policy,
    reload,
    rules_df,
    save_policy,
)
from maskframe.sources.retention import retain_days
from maskframe.sources.sinks import write_audit, write_masked
from maskframe.sources.tables import (
    columns_df,
    footer_counts,
    jdbc_plan,
    jdbc_predicates,
    known_counts,
    read_tables,
    row_counts,
    schema_report,
)


def session_conf() -> dict[str, str]:
    """Session settings that suit wide masking projections.

    Java does not compile methods over 8,000 bytes of byte code.  A projection
    over many masked columns exceeds that as one fused method; below the limit
    Spark splits it into methods that are compiled.
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }


__all__ = [
    "AuditConfig", "HealthConfig", "LimitsConfig", "MaskPolicy", "Rule", "ScanConfig", "as_of",
    "change_log", "columns_df", "contains_pii", "export_rules", "findings", "footer_counts",
    "holds_personal_data", "import_rules", "is_json", "is_scannable", "jdbc_plan",
    "jdbc_predicates", "known_counts", "leaf_scan", "load_policy", "looks_like_json",
    "looks_like_pg_array", "mask", "mask_as_of", "mask_json", "mask_nested", "mask_pg_array",
    "mask_prose", "mask_sample", "mask_sql", "mask_text", "mask_value", "masking_counters",
    "masking_counters_wide", "name_pii_type", "observed", "partial", "pii_type", "preview",
    "profile", "prose_log", "prose_scan", "quick", "read_tables", "redact_text",
    "register_functions", "register_strategy", "reload", "resolve_rules", "resolved_rules_df",
    "retain_days", "row_counts", "rules_df", "rules_summary", "save_policy", "scan", "scan_paths",
    "scan_summary", "schema_report", "session_conf", "strategy_names", "strategy_of",
    "suggest_rules", "token_bucket", "token_scan", "type_breakdown", "uncovered", "write_audit",
    "write_masked",
]
