"""Merging by all field rules, against a plain version on random rows."""

import datetime as dt
import random

from brindle.operators import merging as MG

SCHEMA = "g string, " + ", ".join(f"{k} {v}" for k, v in MG.COLUMNS.items())
T0 = dt.datetime(2026, 5, 1, 20)


def some(r, *values):
    return r.choice(values)


def random_row(r, n):
    day = lambda: T0 + dt.timedelta(days=r.randrange(9), hours=r.randrange(3))
    link = lambda: f"https://{some(r, 'a.example', 'www.facebook.com/events', 'fb.me', 'b.example')}/{r.randrange(3)}"
    return {
        "g": some(r, None, *(f"g{i}" for i in range(40))), "id": f"i{r.randrange(12)}", "ord": n, "source": some(r, "s", "t", None, ""), "source_rank": r.randrange(3), "name": f"n{n}", "start_local": some(r, None, day(), day()), "end_local": some(r, None, day()),
        "recurring": some(r, None, False, True), "recurrences": some(r, None, None, [], sorted([day(), day()])), "schedule": some(r, None, "", f"sch{n}"), "location": some(r, None, " ", f"loc{n}"), "location_override": some(r, None, None, "", f"over{n}"),
        "lat": some(r, None, 1.0 * n), "lng": some(r, None, 2.0 * n), "description": some(r, None, "", f"text{n}"), "cost": some(r, None, "", "Free", "free ", f"${n}", f"{n} USD"), "styles": some(r, None, [], ["other"], ["salsa", f"x{n}"]),
        "special": some(r, None, None, False, True), "ruling": some(r, None, "", f"rule{n}"), "verified_at": some(r, None, day()), "verified_status": some(r, None, "confirmed"), "verified_note": some(r, None, "", "seen"), "url": some(r, None, "", link()),
        "urls": some(r, None, [], [link(), link()]), "dropped_urls": some(r, None, None, [link()]), "time_override": some(r, None, None, None, (day(), some(r, None, day()))),
    }


def host(u):
    h = u.split("://")[1].split("/")[0]
    return h.removeprefix("www.")


def fit(u):
    return 40 if "fb.me/" in u else (20 if "facebook" in u else 10)


def plain(rows):
    rows = sorted(rows, key=lambda x: (x["source_rank"], x["ord"]))
    told = lambda v: v is not None and (not isinstance(v, (str, list)) or bool(v.strip() if isinstance(v, str) else v))
    first = lambda k: next((x[k] for x in rows if told(x[k])), None)
    w = rows[0]
    ids = {}
    for x in rows:
        ids.setdefault(x["id"], []).append(x)
    dates = []
    for copies in ids.values():
        e = {"at": (copies[0]["source_rank"], copies[0]["ord"]), "source": copies[0]["source"], "series": any(x["recurring"] or x["recurrences"] for x in copies)}
        for k in ("start_local", "end_local", "recurrences"):
            e[k] = next((x[k] for x in sorted(copies, key=lambda x: -x["ord"]) if told(x[k])), None)
        dates.append(e)
    head = min(dates, key=lambda e: e["at"])
    keeps = min(dates, key=lambda e: (not e["series"], e["at"]))
    chain = [keeps, head]
    if keeps["recurrences"] and keeps["source"]:
        floor = dt.datetime.min
        like = [e for e in dates if e["source"] == keeps["source"] and e["recurrences"]]
        chain.insert(0, max(like, key=lambda e: (max(e["recurrences"] + ([e["start_local"]] if e["start_local"] else [])), e["start_local"] or floor, -e["at"][0], -e["at"][1])))
    out = {k: next((e[k] for e in chain if e[k] is not None), None) for k in ("start_local", "end_local")}
    out["recurrences"] = next((e["recurrences"] for e in [*chain[:-1], *sorted(dates, key=lambda e: e["at"])] if e["recurrences"]), None)
    fixed = first("time_override")
    for k, v in zip(("start_local", "end_local"), fixed or (None, None)):
        out[k] = v or out[k]
    cost = first("cost")
    if cost and cost.strip().lower() == "free":
        cost = next((x["cost"] for x in rows if x["cost"] and "$" in x["cost"]), cost)
    point = next(((x["lat"], x["lng"]) for x in rows if x["lat"] is not None and x["lng"] is not None), (w["lat"], w["lng"]))
    per_host, gone = {}, {}
    for x in rows:
        for u in [x["url"], *(x["urls"] or [])]:
            if told(u):
                per_host.setdefault(host(u), u)
        for u in x["dropped_urls"] or []:
            gone[u] = u
    links = [u for u in per_host.values() if u not in gone] or list(per_host.values())
    url = min(links, key=fit) if links else None
    styles = next((x["styles"] for x in rows if x["styles"] and x["styles"] != ["other"]), w["styles"])
    return out | {
        "id": w["id"], "source": w["source"], "name": w["name"], "recurring": any(x["recurring"] for x in rows), "location": w["location_override"] if told(w["location_override"]) else first("location"), "lat": point[0], "lng": point[1], "cost": cost, "styles": styles,
        **{k: first(k) for k in MG._FILLED}, "url": url, "urls": [u for u in links if u != url] if links else None, "dropped_urls": sorted(gone) or None, "members": len(rows),
    }


def test_merge_rows_is_the_plain_merge(spark):
    r = random.Random(7)
    rows = [random_row(r, n) for n in range(400)]
    df = spark.createDataFrame([tuple(x[k.split()[0]] for k in ["g", *MG.COLUMNS]) for x in rows], SCHEMA).repartition(5)
    got = {x["g"]: x.asDict() for x in MG.merge_rows(df, "g").collect()}
    assert len(got) == len({x["g"] for x in rows})
    for g, mine in got.items():
        theirs = plain([x for x in rows if x["g"] == g])
        mine["time_override"] = mine["time_override"] and tuple(mine["time_override"])
        assert set(mine) == set(theirs) | {"g"}
        for k, v in theirs.items():
            assert mine[k] == v, (g, k, mine[k], v)


def test_few_columns_and_no_rows(spark):
    df = spark.createDataFrame([("g", "a", 1, "Free"), ("g", "b", 2, "20 at the box")], "g string, id string, ord long, cost string")
    df = df.withColumn("source", df.id)
    got = MG.merge_rows(df, "g", ticketing=("b",)).collect()
    assert [(x.id, x.cost, x.members, x.url, x.recurrences) for x in got] == [("a", "20 at the box", 2, None, None)]
    assert MG.merge_rows(df.limit(0), "g").collect() == []
