"""Queries and SQL of this package over the driver's tables."""

from __future__ import annotations

from quillon.llm import frequency, leaks, mixture, overlaps, rebalance, replies, splits, subjects
from quillon.plans import text_sql
from quillon.sources import table


def _p1_found(spark, d):
    return rebalance.shortfalls(table(spark, d, "qa_rows"), table(spark, d, "rebalance_targets"))


def _p1_report(spark, d):
    return rebalance.report(table(spark, d, "qa_rows"), table(spark, d, "rebalance_targets"), table(spark, d, "pre_rebalance_dataset_stats"))


def _p1_sample(spark, d):
    return rebalance.sample(table(spark, d, "qa_rows"), table(spark, d, "rebalance_targets"))


def _p2_found(spark, d):
    return splits.leaking_sources(table(spark, d, "qa_rows"))


def _p2_assigned(spark, d):
    return splits.assign_splits(table(spark, d, "qa_rows"), table(spark, d, "split_targets"))


def _p2_report(spark, d):
    return splits.split_report(_p2_assigned(spark, d))


def _p4_found(spark, d):
    return frequency.marked_terms(table(spark, d, "predictions"), table(spark, d, "pre_rebalance_dataset_stats"))


def _p4_frequencies(spark, d):
    return frequency.frequency_report(table(spark, d, "predictions"), table(spark, d, "pre_rebalance_dataset_stats"))


def _p7_found(spark, d):
    return leaks.leaked_documents(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def _p7_report(spark, d):
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def _p8_found(spark, d):
    return mixture.dry_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _p8_mix(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _p8_report(spark, d):
    return mixture.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _p3_found(spark, d):
    return replies.broken_replies(table(spark, d, "predictions"))


def _p3_report(spark, d):
    return replies.defect_report(table(spark, d, "predictions"))


def _p5_found(spark, d):
    return overlaps.overlapping_rows(table(spark, d, "qa_rows")).select("id_a", "id_b")


def _p5_report(spark, d):
    return overlaps.overlap_report(table(spark, d, "qa_rows"))


def _p9_found(spark, d):
    return subjects.assigned_subjects(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "doc_subjects"), table(spark, d, "heldout_items"))


def _p9_report(spark, d):
    return subjects.subject_report(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "doc_subjects"), table(spark, d, "heldout_items"))


QUERIES = {
    "p1_found": _p1_found,
    "p1_report": _p1_report,
    "p1_sample": _p1_sample,
    "p2_found": _p2_found,
    "p2_assigned": _p2_assigned,
    "p2_report": _p2_report,
    "p3_found": _p3_found,
    "p3_report": _p3_report,
    "p4_found": _p4_found,
    "p4_frequencies": _p4_frequencies,
    "p5_found": _p5_found,
    "p5_report": _p5_report,
    "p7_found": _p7_found,
    "p7_report": _p7_report,
    "p8_found": _p8_found,
    "p8_mix": _p8_mix,
    "p8_report": _p8_report,
    "p9_found": _p9_found,
    "p9_report": _p9_report,
}

_TYPE = "regexp_replace(lower(question_type), '[^a-z0-9]', '', 'g')"
_TERMS = r"""
WITH p AS (SELECT pred_id, arg_max(coalesce(gold_answer, ''), scored_at) AS g FROM predictions GROUP BY 1),
t AS (SELECT pred_id, unnest(regexp_extract_all(lower(g), '[\p{L}\p{Nd}]+')) AS term FROM p),
gold AS (SELECT term, count(*) AS occurrences, count(DISTINCT coalesce(pred_id, -1)) AS records FROM t GROUP BY 1),
s AS (SELECT snapshot_id, question_type, computed_at, max(top_answers) AS a FROM pre_rebalance_dataset_stats GROUP BY 1, 2, 3),
u AS (SELECT snapshot_id, question_type, computed_at, unnest(a) AS e FROM s),
v AS (SELECT snapshot_id, question_type, computed_at, trim(regexp_replace(lower(e.answer), '\s+', ' ', 'g')) AS term FROM u WHERE e.answer IS NOT NULL),
w AS (SELECT snapshot_id, question_type, computed_at, term, count(*) AS n FROM v GROUP BY 1, 2, 3, 4),
top AS (SELECT term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records FROM w GROUP BY 1),
r AS (
  SELECT 'gold_answer' AS field, term, occurrences, records,
         CASE WHEN records < 3 THEN 'too_rare' WHEN records > 0.05 * (SELECT count(*) FROM p) THEN 'too_common' END AS mark FROM gold
  UNION ALL
  SELECT 'top_answers', term, occurrences, records,
         CASE WHEN records < 3 THEN 'too_rare' WHEN records > 0.20 * (SELECT count(*) FROM s) THEN 'too_common' END FROM top)
"""

SQL = {
    "p1_found": f"""
WITH q AS (SELECT snapshot_id, {_TYPE} AS t, count(DISTINCT id) AS n FROM qa_rows WHERE question_type IS NOT NULL GROUP BY 1, 2)
SELECT r.snapshot_id, r.question_type FROM rebalance_targets r
LEFT JOIN q ON q.snapshot_id = r.snapshot_id AND q.t = {_TYPE.replace('question_type', 'r.question_type')}
WHERE coalesce(n, 0) < greatest(min_rows, floor(target_share * sample_rows + 0.5))""",
    # Names of one scene under any spelling, in more than one split.
    "p2_found": f"""
WITH n AS (SELECT DISTINCT source_id, coalesce({text_sql._SCENE}, 'as written ' || source_id) AS s, {text_sql._SPLIT} AS x FROM qa_rows WHERE source_id IS NOT NULL)
SELECT DISTINCT source_id FROM n WHERE s IN (SELECT s FROM n WHERE x IS NOT NULL GROUP BY 1 HAVING count(DISTINCT x) > 1)""",
    "p4_found": _TERMS + "SELECT field, term, mark FROM r WHERE mark IS NOT NULL",
    "p4_frequencies": _TERMS + "SELECT * FROM r",
    # Sizes in characters: TESTDATA says that no row lies near the limit, whatever the tokenizer.
    "p8_found": f"""
WITH d AS (SELECT doc_id, arg_max(struct_pack(s := coalesce(source, ''), t := coalesce(text, '')), collected_at) AS r FROM documents GROUP BY 1),
z AS (SELECT {_TYPE.replace('question_type', 'r.s')} AS k, sum(length(r.t)) AS n FROM d GROUP BY 1), w AS (SELECT sum(n) AS n FROM z)
SELECT m.mix_id, m.source FROM mix_targets m CROSS JOIN w LEFT JOIN z ON z.k = {_TYPE.replace('question_type', 'm.source')}
WHERE coalesce(z.n, 0) * m.max_repeats < m.target_share * m.mix_ratio * w.n""",
}
