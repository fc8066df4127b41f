"""Queries of reviewers' answers. Questions and answers are derived from listings and decisions."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import SPECIAL_EDITION
from ..operators import answers as AN
from . import duck as D
from .registry import query

c = F.col
L = "v_listing"
#: By the listing's number: kind of question, and what same, different and approve stand for in it.
_ASKED = [
    ("new", "approve", "already_listed", "off_topic"), ("possible_duplicate", "same", "different", "no_link_yet"), ("active_duplicate", "same", "different", "nonsense"), ("rejected", "restore", "elsewhere", "restore"), ("venue_conflict", "distinct", "replaces", "duplicate"),
    ("signal", "not_an_event", "not_an_event", "add"), ("date", "use_source_date", "not_happening", "keep"), ("location", "use_source_place", "keep", "keep"), ("no_link", "archive", "archive", "attach"), ("broken_link", "drop_link", "replace", "drop_link"), ("cancelled", "confirm", "keep", "keep"),
]
_KIND = "CASE ord % 11 " + " ".join(f"WHEN {i} THEN {D.q(k[0])}" for i, k in enumerate(_ASKED)) + " END"
_CHOICE = "CASE choice " + " ".join(f"WHEN '{said}' THEN CASE item % 11 " + " ".join(f"WHEN {i} THEN {D.q(k[n])}" for i, k in enumerate(_ASKED)) + " END" for n, said in ((1, "same"), (2, "different"), (3, "approve"))) + " ELSE 'skip' END"
_NOTE = "CASE item % 4 WHEN 0 THEN NULL WHEN 1 THEN '  short ' ELSE ' seen on the page itself ' END"
_PLACE = "CASE WHEN ord % 5 > 0 THEN 'Annex, ' || location END"

_RULES = ", ".join(f"({', '.join(D.q(x) for x in (kind, choice, needs, *change))})" for kind, choice, needs, every in AN.RULES for change in every)
_LOG = f"""WITH RECURSIVE ru(kind, choice, needs, tbl, action, whose, value) AS (VALUES {_RULES}),
ls AS (SELECT *, {D.norm('name')} AS norm FROM v_listing), wl AS (SELECT ord AS item, {_KIND} AS kind, id AS subject, 'L' || (ord + ord % 4)::VARCHAR AS other, CASE WHEN ord % 3 > 0 THEN start_local::DATE + 2 END AS source_day, {_PLACE} AS source_place FROM v_listing),
an AS (SELECT item, seq, {_CHOICE} AS choice, {_NOTE} AS note FROM v_decision), va AS (SELECT an.* FROM an JOIN wl USING (item) WHERE EXISTS (SELECT 1 FROM ru WHERE ru.kind = wl.kind AND ru.choice = an.choice)),
ch AS (SELECT * FROM va QUALIFY row_number() OVER (PARTITION BY item ORDER BY seq DESC, choice DESC, note DESC) = 1),
f AS (SELECT wl.*, ch.seq, ch.choice, trim(ch.note) AS note, s.ord AS so, s.location AS sl, s.url AS su, s.start_local::DATE::VARCHAR AS sd, s.norm AS sn, o.ord AS oo, o.norm AS onorm FROM wl JOIN ch USING (item) JOIN ls s ON s.id = subject LEFT JOIN ls o ON o.id = other),
j AS (SELECT f.*, needs, tbl, action, whose, value, CASE WHEN contains(needs, 'other') AND oo IS NULL THEN 'no other listing' WHEN list_contains(string_split(needs, ' '), 'place') AND coalesce(trim(sl), '') = '' THEN 'no place' WHEN needs = 'source_day' AND source_day IS NULL THEN 'no date to use'
    WHEN needs = 'source_place' AND coalesce(source_place, '') = '' THEN 'no place to use' WHEN needs = 'note' AND length(coalesce(note, '')) < 10 THEN 'no note'
    WHEN contains(needs, 'not_special') AND regexp_matches(sn, {D.q('(?i)' + SPECIAL_EDITION)}) <> regexp_matches(onorm, {D.q('(?i)' + SPECIAL_EDITION)}) THEN 'special edition' END AS refused FROM f JOIN ru USING (kind, choice)),
lg AS (SELECT DISTINCT item, kind, choice, refused, CASE WHEN refused IS NULL THEN tbl END AS tbl, CASE WHEN refused IS NULL THEN action END AS action,
  CASE WHEN refused IS NULL THEN CASE whose WHEN 'other' THEN other WHEN 'later' THEN CASE WHEN so < oo THEN other ELSE subject END ELSE subject END END AS id,
  CASE WHEN refused IS NULL THEN CASE value WHEN '=other' THEN other WHEN '=earlier' THEN CASE WHEN so < oo THEN subject ELSE other END WHEN '=day' THEN sd WHEN '=source_day' THEN source_day::VARCHAR WHEN '=source_place' THEN source_place WHEN '=note' THEN note WHEN '=url' THEN su ELSE value END END AS value, seq FROM j)"""
_LAST = "lp AS (SELECT * FROM lg WHERE tbl = 'pools' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, item DESC) = 1), lh AS (SELECT * FROM lg WHERE tbl = 'holds' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, item DESC) = 1)"


def _log(t: DataFrame, d: DataFrame) -> DataFrame:
    """Every listing has a question. (Here the other listing is up to three numbers on, the source's day two days later, its place the annex.)"""
    name = F.concat(F.lit("L"), (c("ord") + c("ord") % 4).cast("string"))
    work = t.select(c("ord").alias("item"), F.expr(_KIND).alias("kind"), c("id").alias("subject"), name.alias("other"), F.when(c("ord") % 3 > 0, F.date_add(F.to_date("start_local"), 2)).alias("source_day"), F.expr(_PLACE).alias("source_place"))
    return AN.apply_answers(work, d.select("item", "seq", F.expr(_CHOICE).alias("choice"), F.expr(_NOTE).alias("note")), t)


@query("apply_answers", L, "v_decision", sql=f"{_LOG} SELECT * FROM lg")
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    return _log(t, d)


@query("answered_pools", L, "v_decision", sql=f"""{_LOG}, {_LAST}, mg AS (SELECT id, value AS hop, 1 AS n FROM lp WHERE action = 'merged' UNION ALL SELECT mg.id, lp.value, n + 1 FROM mg JOIN lp ON lp.id = mg.hop AND lp.action = 'merged' WHERE n < 32),
en AS (SELECT id, arg_max(hop, n) AS hop FROM mg GROUP BY id HAVING arg_max(hop, n) NOT IN (SELECT id FROM lp WHERE action = 'merged'))
SELECT l.id, CASE WHEN action = 'to' THEN value WHEN action = 'gone' OR en.hop IS NOT NULL THEN NULL ELSE pool END AS pool, CASE WHEN CASE WHEN action = 'to' THEN value WHEN action = 'gone' OR en.hop IS NOT NULL THEN NULL ELSE pool END = 'archive' THEN lh.value END AS hold, en.hop AS merged_into
FROM v_listing l LEFT JOIN lp ON lp.id = l.id LEFT JOIN en ON en.id = l.id LEFT JOIN lh ON lh.id = l.id""".replace("CASE WHEN action = 'to' THEN value", "CASE WHEN lp.action = 'to' THEN lp.value").replace("WHEN action = 'gone'", "WHEN lp.action = 'gone'"))
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    return AN.pools_after(t, _log(t, d))


@query("answered_verdicts", L, "v_decision", sql=f"""{_LOG}, fr AS (SELECT least(id, value) AS a, greatest(id, value) AS b, action AS verdict FROM lg WHERE tbl = 'verdicts' QUALIFY row_number() OVER (PARTITION BY least(id, value), greatest(id, value) ORDER BY seq DESC, item DESC) = 1),
old AS (SELECT least(id, 'L' || (ord + 1)::VARCHAR) AS a, greatest(id, 'L' || (ord + 1)::VARCHAR) AS b FROM v_listing WHERE recurring) SELECT * FROM fr UNION ALL SELECT a, b, 'same' FROM old WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.a = old.a AND fr.b = old.b)""")
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    """(Here each recurring listing was the same as the next before.)"""
    nxt = F.concat(F.lit("L"), (c("ord") + 1).cast("string"))
    return AN.verdicts_after(t.filter("recurring").select(F.least("id", nxt).alias("a"), F.greatest("id", nxt).alias("b"), F.lit("same").alias("verdict")), _log(t, d))


@query("answered_edits", L, "v_decision", sql=f"""{_LOG}, le AS (SELECT * FROM lg WHERE tbl = 'edits' QUALIFY row_number() OVER (PARTITION BY id, action ORDER BY seq DESC, item DESC) = 1),
pe AS (SELECT id, max(value) FILTER (action = 'start_day')::DATE AS sd, max(value) FILTER (action = 'location') AS lo, max(value) FILTER (action = 'removed_url') AS ru, max(value) FILTER (action = 'manual_check') AS mc FROM le GROUP BY id)
SELECT l.id, start_local + INTERVAL 1 DAY * coalesce(date_diff('day', start_local::DATE, sd), 0) AS start_local, end_local + INTERVAL 1 DAY * coalesce(date_diff('day', start_local::DATE, sd), 0) AS end_local, coalesce(lo, location) AS location, CASE WHEN ru IS DISTINCT FROM url THEN url END AS url, ru AS dropped, mc AS manual_check FROM v_listing l JOIN pe ON pe.id = l.id""")
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    return AN.edits_after(t, _log(t, d))


@query("answered_blocks", L, "v_decision", sql=f"""{_LOG}, lb AS (SELECT * FROM lg WHERE tbl = 'blocks' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, item DESC) = 1)
SELECT l.id, source, norm || '|' || coalesce(lower(trim(location)), '') AS key, value AS category FROM lb JOIN ls l ON l.id = lb.id""")
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    none = t.sparkSession.createDataFrame([], "id string, source string, key string, category string")
    return AN.blocks_after(none, t, _log(t, d))
