"""DuckDB SQL for expressions that many oracle queries share."""

from __future__ import annotations

from ..functions import names, places, text
from ..functions.timefn import DAYS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {q('(?i)' + pattern)}), false)"


def norm(x: str) -> str:
    out = f"lower({x})"
    for pattern, to in names.NAME_STEPS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, 'g')"
    return f"trim({out})"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def words(x: str) -> str:
    """Content words of a normal name, sorted."""
    return f"list_sort([w for w in list_distinct(string_split({x}, ' ')) if w <> '' AND NOT list_contains({array(names.STOP_WORDS)}, w)])"


def telling(x: str) -> str:
    common = names.GENERIC_WORDS + [d + s for d in names.WEEKDAYS for s in ("", "s")]
    return f"[w for w in {x} if length(w) >= 3 AND NOT list_contains({array(common)}, w)]"


def styles(x: str, found: dict[str, str] = text.STYLES) -> str:
    parts = " || ".join(f"CASE WHEN {has(x, p)} THEN [{q(s)}] ELSE [] END" for s, p in found.items())
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE ['other'] END"


def km(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(({a} - ({c})) * ({a} - ({c})) + (({b} - ({d})) * cos(radians({a}))) * (({b} - ({d})) * cos(radians({a})))) * {places.KM_PER_DEGREE}"


def key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '/+$', ''))"


def host(x: str) -> str:
    return f"regexp_extract(lower({x}), '^https?://(?:www\\.)?([^/]+)', 1)"


def rank(x: str) -> str:
    h = host(x)
    return f"""CASE WHEN coalesce({x}, '') = '' THEN 100 WHEN regexp_matches(lower({x}), 'facebook\\.com/(?:events/s/|share/)|fb\\.me/') THEN 40
      WHEN contains({h}, 'facebook.com') OR contains({h}, 'fb.com') THEN CASE WHEN contains(lower({x}), '/events/') THEN 20 ELSE 30 END
      WHEN contains({h}, 'instagram.com') THEN 30 ELSE 10 END"""


def day_name(ts: str) -> str:
    return f"{array(DAYS)}[dayofweek({ts}) + 1]"


def cancelled(x: str) -> str:
    """Whether any mention of a cancellation in the first 5000 characters has no condition in the 80 before it."""
    head = f"({x})[1:5000]"
    parts, said = f"string_split_regex({head}, {q('(?i)' + text.CANCELLED)})", f"regexp_extract_all({head}, {q('(?i)' + text.CANCELLED)})"
    before = f"array_to_string([({parts})[j] || CASE WHEN j < i THEN ({said})[j] ELSE '' END for j in range(1, i + 1)], '')"
    return f"len([i for i in range(1, len({said}) + 1) if NOT regexp_matches(right({before}, 80), {q('(?i)' + text.CONDITIONAL)})]) > 0"


def unescape(x: str) -> str:
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(entity)}, {q(to)})"
    return x


#: Listings with the columns that pairs are judged by.
PREPARED = f"""p AS (SELECT *, {norm("name")} AS norm, lower(trim(location)) AS place, start_local::DATE AS day, {key("url")} AS key FROM v_listing),
nw AS (SELECT name, norm, {words("norm")} AS words, [s for s in {styles("name")} if s <> 'other'] AS known, [d for d in {array(names.WEEKDAYS)} if contains(lower(name), d)] AS days FROM (SELECT DISTINCT name, norm FROM p)),
nt AS (SELECT *, {telling("words")} AS telling FROM nw), prep AS (SELECT p.*, words, telling FROM p JOIN nt USING (name))"""


def shared(a: str, b: str) -> str:
    """Words shared by two sorted lists: equal ones, plus other words of three letters or more with one within one edit. Right where no
    word could match two others, as in the names here."""
    return f"""(len(list_intersect({a}, {b})) + len([w for w in {a} if length(w) >= 3 AND NOT list_contains({b}, w)
      AND len([v for v in {b} if length(v) >= 3 AND NOT list_contains({a}, v) AND levenshtein(w, v) <= 1]) > 0]))"""


#: What is true of two names, once for each two that are met.
_NAMES = f"""np AS (SELECT x.name AS xn, y.name AS yn, x.norm = y.norm AS exact, contains(x.norm, y.norm) OR contains(y.norm, x.norm) AS inside, len(list_intersect(x.telling, y.telling)) > 0 AS telling_word,
    {shared("x.words", "y.words")} >= greatest(2.0, 0.5 * least(len(x.words), len(y.words))) AND len(list_intersect(x.telling, y.telling)) > 0 AS strong,
    len([s for s in x.known if NOT list_contains(y.known, s)]) > 0 AND len([s for s in y.known if NOT list_contains(x.known, s)]) > 0 AND len(x.known) > 0 AND len(y.known) > 0 AS other_styles,
    len(x.days) > 0 AND len(y.days) > 0 AND len(list_intersect(x.days, y.days)) = 0 AS other_days FROM nt x, nt y)"""

#: All pairs that start within a week, recur on one weekday, share an address, or have an unknown start: any other has no grade.
PAIRS = f"""{_NAMES}, near AS (
    SELECT x.ord AS xo, y.ord AS yo FROM prep x JOIN prep y ON x.start_local > y.start_local - INTERVAL 168 HOUR AND x.start_local < y.start_local + INTERVAL 168 HOUR WHERE x.ord < y.ord
    UNION SELECT x.ord, y.ord FROM prep x JOIN prep y ON x.recurring AND y.recurring AND dayofweek(x.start_local) = dayofweek(y.start_local) AND x.ord < y.ord
    UNION SELECT x.ord, y.ord FROM prep x JOIN prep y ON x.key = y.key AND x.key <> '' AND x.ord < y.ord
    UNION SELECT least(x.ord, y.ord), greatest(x.ord, y.ord) FROM prep x JOIN prep y ON x.start_local IS NULL AND x.norm = y.norm AND x.ord <> y.ord),
pr AS (
  SELECT x.id AS a, y.id AS b, xo, yo, x.source AS xs, y.source AS ys, abs(date_diff('second', x.start_local, y.start_local)) AS gap, x.day = y.day AS same_day, coalesce(x.place = y.place, false) AS place_text,
    coalesce({km("x.lat", "x.lng", "y.lat", "y.lng")} <= 0.3, false) AS close, coalesce({km("y.lat", "y.lng", "x.lat", "x.lng")} <= 0.3, false) AS close_back,
    x.recurring AND y.recurring AND dayofweek(x.start_local) = dayofweek(y.start_local) AS both_recur, x.recurring AND y.recurring AS recurring,
    abs(hour(x.start_local) * 60 + minute(x.start_local) - hour(y.start_local) * 60 - minute(y.start_local)) AS c0, x.key = y.key AND x.key <> '' AS same_url,
    exact, inside, strong, telling_word, other_styles, other_days
  FROM near JOIN prep x ON x.ord = xo JOIN prep y ON y.ord = yo JOIN np ON xn = x.name AND yn = y.name),
cand AS (SELECT a, b FROM pr WHERE same_url OR ((place_text OR close OR close_back) AND (gap < 604800 OR both_recur AND (exact OR telling_word))) OR (exact AND gap IS NULL) OR ((exact OR inside OR telling_word) AND gap < 86400))"""

#: The first rule that fits.
GRADED = """g AS (SELECT *, place_text OR close AS same_place, gap < 86400 AS soon FROM pr),
graded AS (SELECT *, CASE WHEN same_url AND coalesce(soon, true) THEN 'certain'
    WHEN same_day AND same_place AND (exact OR inside OR strong) THEN 'certain' WHEN exact AND same_place AND soon THEN 'certain'
    WHEN same_place AND (exact OR strong) AND both_recur THEN CASE WHEN other_styles OR least(c0, 1440 - c0) > 120 THEN 'review' ELSE 'certain' END
    WHEN exact AND soon THEN 'review' WHEN same_place AND same_day THEN 'review' WHEN inside AND soon THEN 'review' WHEN strong AND soon THEN 'review'
    WHEN exact AND gap IS NULL THEN 'review'
    WHEN same_place AND (exact OR inside OR strong) AND gap < 604800 AND NOT (recurring AND other_days) THEN 'review' END AS grade FROM g)"""
