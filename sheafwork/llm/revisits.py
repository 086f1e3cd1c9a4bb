"""Not-modified revisits of a web archive, resolved to the full response that they confirm.

A revisit is matched with the latest earlier full response of the same canonical URL. If its
validators agree with that response's, it gets the response's payload and headers, updated by those
headers that a 304 answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import keep, new_folder

#: Headers that a 304 answer may update (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLOT_SECONDS = 86_400


def canonical(uri: Column) -> Column:
    """Scheme and host in lower case, no port that is the scheme's own (80 of http, 443 of https), no fragment, no ``utm_`` parameters, the others sorted.

    An empty path becomes ``/``. A text without ``://`` only loses its fragment; null stays null.
    """
    bare = F.regexp_replace(uri, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.regexp_extract(bare, r"^[^:]*://([^/?]*)", 1)
    user, name = F.regexp_extract(authority, r"(?s)^(.*@)", 1), F.lower(F.regexp_replace(authority, r"(?s)^.*@", ""))
    plain = F.when(scheme == "http", F.regexp_replace(name, r":80$", "")).when(scheme == "https", F.regexp_replace(name, r":443$", ""))
    host = F.concat(user, F.coalesce(plain, name))
    path = F.regexp_extract(bare, r"(?s)^[^:]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(scheme == "", bare).otherwise(whole)


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the first stays. Null is empty."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    values = F.transform(names, lambda n: F.filter(entries, lambda e: e["name"] == n)[0]["value"])
    return F.coalesce(F.map_from_arrays(names, values), F.create_map().cast("map<string,string>"))


def merged(stored: Column, update: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """The stored headers with the permitted ones of the update."""
    new = F.map_filter(update, lambda k, _: k.isin(*permitted))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(new, k)), new)


def verdict(stored: Column, update: Column) -> Column:
    """``resolved`` if entity tags agree (weakly), or without two tags the modification dates; ``mismatch`` or ``unverified`` else."""
    tag = lambda h: F.regexp_replace(h["etag"], r"^W/", "")
    dates = stored["last-modified"], update["last-modified"]
    by_date = F.when(dates[0] == dates[1], "resolved").when(dates[0] != dates[1], "mismatch").otherwise("unverified")
    return F.when(tag(stored) == tag(update), "resolved").when(tag(stored) != tag(update), "mismatch").otherwise(by_date)


def header_lines(headers: Column) -> Column:
    """``name: value`` lines, sorted; a null value is empty."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(lines), "\n")


def resolve(records: DataFrame, slot_seconds: int = SLOT_SECONDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each revisit: ``record_id, uri, ref_id, verdict, headers`` and the columns ``carry``.

    ``records`` has ``record_id, kind ('response' or 'revisit'), uri, time (seconds), headers
    (map<string,string>)``; other columns are ignored. A response of the same second isn't earlier;
    of responses of one second the one with the largest id counts. Without an earlier response, URL
    or time the verdict is ``orphan``; only resolved revisits get merged headers, the others keep their own.
    ``carry`` names columns of the response, such as its payload, that resolved revisits get; they are null
    for the others. Repeated revisits give repeated rows, ids may be null; a response without an id confirms
    nothing, and of responses that share id, URL and time the one with the largest headers counts. An
    empty table gives no rows.

    Times are cut into slots. The last response of each slot is found by a sum in every task and carried
    into the next slots of its URL, so the records of one busy URL are spread over its slots. Orphans take
    no part in the join with responses.
    """
    folder = new_folder(records.sparkSession)
    full = F.col("kind") == "response"
    keys = keep(
        records.where("kind = 'revisit' or (kind = 'response' and record_id is not null)").select(
            "record_id",
            full.alias("full"),
            canonical(F.col("uri")).alias("url"),
            F.col("time").cast("long").alias("time"),
            lower_names(F.col("headers")).alias("headers"),
            F.when(full, F.struct(F.lit(0).alias("_"), *carry)).alias("extra"),
        ),
        folder,
        "records",
    )
    timed = keys.where("url is not null and time is not null").withColumn("slot", F.floor(F.col("time") / slot_seconds))
    seen = F.struct("time", "record_id")
    slots = timed.groupBy("url", "slot").agg(F.max(F.when(F.col("full"), seen)).alias("last"))
    earlier = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = keep(slots.select("url", "slot", F.max("last").over(earlier).alias("carried")), folder, "carried")
    inside = Window.partitionBy("url", "slot").orderBy("time", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    # A revisit takes its headers along; a response is only seen by time and id.
    light = timed.select("url", "slot", "time", "full", "record_id", F.when(~F.col("full"), F.col("headers")).alias("headers"))
    near = light.withColumn("near", F.max(F.when(F.col("full"), seen)).over(inside)).where("not full")
    matched = near.join(carried, ["url", "slot"]).select("record_id", "url", "headers", F.coalesce("near", "carried").alias("ref"))
    matched = keep(matched, folder, "matched")
    response = F.max_by(F.struct("headers", "extra"), F.struct(header_lines(F.col("headers")), "extra"))
    stored = timed.where("full").groupBy("url", F.col("time").alias("ref_time"), F.col("record_id").alias("ref_id")).agg(response.alias("stored"))
    stored = keep(stored, folder, "stored")
    told = matched.where("ref is not null").select("record_id", "url", "headers", F.col("ref.time").alias("ref_time"), F.col("ref.record_id").alias("ref_id"))
    told = told.join(stored, ["url", "ref_time", "ref_id"], "left")
    told = told.withColumn("verdict", verdict(F.col("stored.headers"), F.col("headers")))
    resolved = F.col("verdict") == "resolved"
    told = told.select(
        "record_id",
        F.col("url").alias("uri"),
        "ref_id",
        "verdict",
        F.when(resolved, merged(F.col("stored.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        *(F.when(resolved, F.col("stored.extra")[c]).alias(c) for c in carry),
    )
    untimed = keys.where("not full and (url is null or time is null)").select("record_id", "url", "headers")
    alone = matched.where("ref is null").select("record_id", "url", "headers").unionByName(untimed)
    kinds = {f.name: f.dataType for f in told.schema.fields}
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in carry]
    alone = alone.select("record_id", F.col("url").alias("uri"), F.lit(None).cast(kinds["ref_id"]).alias("ref_id"), F.lit("orphan").alias("verdict"), "headers", *nothing)
    return told.unionByName(alone)


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from a table of pages: a response of each, revisits, and later responses of some.

    The revisits spell the URL in other ways; some have other validators, and some come before any response.
    """
    sha = F.sha2(F.coalesce("html", F.lit("")), 256)
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), (F.col("page_id") * 600).alias("t"), sha.alias("sha"), F.char_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    text = lambda c: c.cast("string")
    quoted = lambda start, n: F.concat(F.lit('"' + start), F.substring("sha", 1, n), F.lit('"'))
    pairs = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)))
    t, third = F.col("t"), F.col("page_id") % 3 == 0
    later = t + 129_600
    bare = F.regexp_replace("url", "#.*$", "")
    loud = F.concat(F.upper(F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1)), F.when(F.col("url").startswith("https"), ":443").otherwise(":80"), F.regexp_extract(bare, "^[^:]*://[^/?#]*(.*)$", 1), F.lit("#again"))
    tracked = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_medium=mail"))
    when_b = F.when(F.col("page_id") % 7 == 0, t - 60).otherwise(t + 172_800)
    first = pairs(Content_Type=F.lit("text/html"), Content_Length=F.col("size"), Date=text(t), ETag=quoted("", 16), Last_Modified=text(t), Cache_Control=F.lit("max-age=60"))
    second = pairs(Content_Type=F.lit("text/html"), Content_Length=F.col("size"), Date=text(later), ETag=quoted("v2-", 12), Last_Modified=text(later), Cache_Control=F.lit("max-age=60"))
    tag_a = F.when(F.col("page_id") % 5 == 0, '"other"').otherwise(F.concat(F.lit("W/"), quoted("", 16)))
    a = pairs(date=text(t + 86_400), etag=tag_a, cache_control=F.lit("max-age=120"), content_length=F.lit("0"), connection=F.lit("close"))
    b = pairs(date=text(when_b), expires=text(when_b + 60), last_modified=text(F.when(third, later).otherwise(t)))
    row = lambda k, kind, uri, time, headers: F.struct((F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("kind"), uri.alias("uri"), time.alias("time"), headers.alias("headers"), F.col("sha").alias("payload_sha256"))
    made = [row(0, "response", F.col("url"), t, first), row(1, "revisit", loud, t + 86_400, a), row(2, "revisit", tracked, when_b, b)]
    every = F.when(third, F.array(*made, row(3, "response", F.col("url"), later, second))).otherwise(F.array(*made))
    return base.select(F.inline(every))
