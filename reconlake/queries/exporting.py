"""Protocols, payloads and releases as they leave the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.operators import views
from reconlake.plans import shapes
from reconlake.plans.shapes import CHECKS_SQL
from reconlake.queries.registry import query
from reconlake.sources import exports

BUCKETS = ("violations", "verified", "open", "clarifications", "completeness", "other")


@query(
    f"""with {CHECKS_SQL}, f as (
      select process_id, check_id,
        case when status is null then 'completeness' when status = 'CONFIRMED_VIOLATION' then 'violations' when status = 'NEGATIVE_VERIFIED' then 'verified'
          when status = 'CANDIDATE' then 'open' when status = 'CLARIFICATION_REQUIRED' then 'clarifications' else 'other' end as bucket,
        '<finding id="' || check_id || '"' || coalesce(' verified_by="' || verified_by || '"', '') || '>' || '<param>' || param || '</param>'
          || coalesce('<status>' || status || '</status>', '<status/>') || '</finding>' as x
      from visible)
    select process_id, '<protocol id="' || process_id || '">' ||
      {" || ".join(f"'<{b}>' || coalesce(string_agg(x, '' order by check_id) filter (bucket = '{b}'), '') || '</{b}>'" for b in BUCKETS)}
      || '</protocol>' as xml from f group by 1"""
)
def protocol_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.visible(shapes.checks(spark, sf_dir))
    return exports.protocols(shown, "process_id", views.export_bucket(F.col("status")), BUCKETS, ("verified_by",), ("param", "status"))


@query(
    f"""with {CHECKS_SQL}, p as (
      select process_id, to_json({{'process_id': process_id, 'findings': list({{'check_id': check_id, 'param': param, 'verified_by': verified_by}} order by check_id)}})::varchar as payload
      from visible where status = 'CONFIRMED_VIOLATION' group by 1)
    select process_id, payload, sha256(payload) as payload_hash from p"""
)
def transfer_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.payloads(views.visible(shapes.checks(spark, sf_dir)), "process_id", ("check_id", "param", "verified_by"))


@query(
    f"""with {CHECKS_SQL}
    select check_id, to_json({{'check_id': check_id, 'process_id': process_id, 'status': status, 'verified_by': verified_by}})::varchar as line from visible"""
)
def release_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.lines(views.visible(shapes.checks(spark, sf_dir)), "check_id", ("check_id", "process_id", "status", "verified_by"))
