"""Queries of byte ranges, polled tasks, interfaces and the medium that is watched."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.operators import folds, ranges, services
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query


# A document's bytes in four ranges, each with seven bytes of the next; every third document's server ignores ranges, every
# fifth document lacks its third piece, and every seventh one's second range is not the one asked for.
_PIECES = """t as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
q as (select *, (n + 3) // 4 as q from t), r as (select doc_id, h, n, k, k * q as a, least(n, (k + 1) * q + 7) as b from q, range(4) x(k) where k * q < n and not (k = 2 and doc_id % 5 = 0)),
"""


@query("sc29_ranges", "with " + _PIECES + """ok as (select * from r where not (doc_id % 7 = 0 and doc_id % 3 <> 0 and k = 1)),
m as (select *, coalesce(max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding), 0) as reach from ok),
f as (select doc_id, string_agg(substr(h, (2 * greatest(a, reach) + 1)::int, (2 * (b - greatest(a, reach)))::int), '' order by a) filter (b > reach) as body, count(*) filter (a > reach) as holes, max(b) as reach, sum(b - greatest(a, reach)) filter (b > reach) as size from m group by 1)
select q.doc_id as resource, q.n as total, size::bigint as size, (holes + (f.reach < q.n)::int)::bigint as holes, case when holes = 0 and f.reach = q.n then sha256(unhex(body)) end as body_sha256 from q join f using (doc_id)""")
def sc29(spark, d):
    """Documents as files that are fetched in overlapping ranges."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = ad.table(spark, d, "documents").select(F.col("doc_id").alias("resource"), body.alias("whole"), F.octet_length(body).cast("long").alias("n"))
    rows = rows.withColumn("q", F.expr("(n + 3) div 4")).withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    a, b, i = F.col("k") * F.col("q"), F.least("n", (F.col("k") + 1) * F.col("q") + 7), F.col("resource")
    rows = rows.withColumns({"offset": a, "length": b - a}).where((F.col("offset") < F.col("n")) & ~((F.col("k") == 2) & (i % 5 == 0)))
    ignores, wrong = i % 3 == 0, (i % 7 == 0) & (i % 3 != 0) & (F.col("k") == 1)
    cut = F.substring("whole", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    header = F.concat(F.lit("bytes "), (F.col("offset") + wrong.cast("int")).cast("string"), F.lit("-"), (F.col("offset") + F.col("length") - 1 + wrong.cast("int")).cast("string"), F.lit("/"), F.col("n").cast("string"))
    responses = rows.select("resource", "offset", "length", F.when(ignores, 200).otherwise(206).alias("status"), F.when(~ignores, header).alias("content_range"), F.when(ignores, F.col("whole")).otherwise(cut).alias("body"))
    found = ranges.assembled(ranges.pieces(responses))
    return found.select("resource", "total", "size", F.size("holes").cast("long").alias("holes"), F.sha2("body", 256).alias("body_sha256"))


# Tasks are orders, whose lines change their state at the seconds their quantities give.
_STATES = "st as (select l_orderkey as task, (l_quantity * 7 * l_linenumber)::bigint as sec, max(case when l_returnflag = 'A' and l_linenumber > 2 then 'SUCCEEDED' when l_returnflag = 'R' and l_linenumber > 3 then 'FAILED' when l_linestatus = 'F' then 'RUNNING' else 'PENDING' end) as status from lineitem group by 1, 2)"
_SEEN = """pt as (select n as poll, case when n <= 21 then (n - 1) * 10 + (n - 1) * (n - 2) // 2 else 390 + (n - 21) * 30 end as t from range(1, 1000) r(n)), pl as (select * from pt where t < 7200),
sp as (select *, lead(sec) over (partition by task order by sec) as upto from st), fp as (select sp.*, (select min(poll) from pl where t >= sp.sec) as poll from sp where status in ('SUCCEEDED', 'FAILED')),
ft as (select fp.*, pl.t as ended from fp join pl using (poll) where upto is null or upto > pl.t), fo as (select * from ft qualify row_number() over (partition by task order by poll) = 1)"""


@query("ud06_polled_tasks", f"with {_STATES}, {_SEEN} select o_orderkey as task, coalesce(lower(status), 'timed_out') as outcome, coalesce(poll, (select max(poll) from pl))::bigint as polls, ended::double as ended from orders left join fo on task = o_orderkey")
def ud06(spark, d):
    """What polls see of tasks that change their states."""
    lines = ad.table(spark, d, "lineitem")
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    status = F.when((flag == "A") & (n > 2), "SUCCEEDED").when((flag == "R") & (n > 3), "FAILED").when(F.col("l_linestatus") == "F", "RUNNING").otherwise("PENDING")
    states = lines.select(F.col("l_orderkey").alias("task"), (F.col("l_quantity") * 7 * n).cast("long").cast("double").alias("at"), status.alias("status"))
    return services.polled(ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("task")), states)


@query("ud06_speaker_requests", "select l_orderkey as media_id, count(*) between 1 and 3 as tell_apart, case when count(*) between 1 and 3 and max(l_quantity)::bigint between 2 and 100 then max(l_quantity)::bigint end as speakers from lineitem group by 1")
def ud06_speakers(spark, d):
    media = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").cast("long").alias("speakers"))
    asked = services.speaker_request(F.col("n"), F.col("speakers"))
    return media.select("media_id", asked["tell_apart"].alias("tell_apart"), asked["speakers"].alias("speakers"))


#: An interface per part: a request schema that refers to others, in cycles, with alternatives, items and escaped names.
_BODY = """'{"request": {"allOf": [{"$ref": "#/schemas/A"}, {"properties": {"own' || (p_partkey % 5) || '": {}}}]}, "schemas": {"A": {"properties": {"model": {}, "' || lower(p_brand) || '": {}}, "anyOf": [{"$ref": "#/schemas/B~1x"}, {"$ref": "#/schemas/A"}]}, "B/x": {"items": {"oneOf": [{"$ref": "#/schemas/C' || (p_partkey % 3) || '"}, {"properties": {"deep": {}}}]}, "properties": {"' || lower(p_type) || '": {}}}, "C0": {"$ref": "#/schemas/A"}, "C1": {"properties": {"vad_filter": {"properties": {"hidden": {}}}}}}}'"""


@query("ud05_schema_fields", f"""with recursive d as (select p_partkey as doc, {_BODY} as body from part),
w as (select doc, body, '/request' as ptr from d union
  select doc, body, x.ptr from (select doc, body, unnest(case when json_extract_string(body, ptr || '/$ref') is not null then [substr(json_extract_string(body, ptr || '/$ref'), 2)] else list_concat(flatten(list_transform(['allOf', 'anyOf', 'oneOf'], lambda k: list_transform(range(coalesce(json_array_length(body, ptr || '/' || k), 0)::bigint), lambda i: ptr || '/' || k || '/' || i))), [ptr || '/items']) end) as ptr from w) x where json_extract(body, x.ptr) is not null)
select distinct doc, unnest(json_keys(body, ptr || '/properties')) as field from w where json_extract_string(body, ptr || '/$ref') is null""")
def ud05(spark, d):
    """The fields that each interface's request takes."""
    docs = ad.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.expr(_BODY).alias("body"))
    return services.schema_fields(docs, docs.select("doc", F.get_json_object("body", "$.request").alias("node")))


# Each event shows three media of a user's page.
_SHOWN = """ev as (select user_id as media_id, event_id as "at", unnest([0, 1, 2]) as ord, event_id // 3 as r, value from events), sh as (select media_id, "at", ord, (r + ord) % 4 <> 0 as visible, (r // 2 + ord) % 3 = 0 as playing, value, row_number() over (partition by media_id, "at" order by ord) as nth from ev),
sc as (select *, case when visible then 100000000 else 0 end + case when playing then 500000 else 0 end + case when ord = 1 then 1000000 else 0 end + value::bigint * 4 * (ord + 1) + 2000 + case when "at" % 2 = 0 then 10000 else 0 end + 5000 as score from sh)"""


@query("a18_watched_media", f'''with recursive {_SHOWN}, ob as (select media_id, "at", list(struct_pack(s := score, o := ord, v := visible, p := playing) order by score desc, ord) as m, row_number() over (partition by media_id order by "at") as n from sc group by 1, 2),
fo as (select media_id, 0::bigint as n, 0::bigint as "at", -1 as last from (select distinct media_id from ob) union all
  select media_id, n, "at", case when st is null then m[1].o when bt is not null and bt.s > st.s then bt.o else st.o end from (select ob.*, list_filter(ob.m, lambda x: x.o = fo.last and (x.v or x.p))[1] as st, list_filter(ob.m, lambda x: x.o <> fo.last and x.v and x.p)[1] as bt from fo join ob on ob.media_id = fo.media_id and ob.n = fo.n + 1))
select media_id, "at", last::bigint as ord from fo where n > 0''')
def a18(spark, d):
    """The medium of a page that is watched, which stays unless a better one plays."""
    r, o = F.floor(F.col("at") / 3), F.col("ord")
    rows = ad.table(spark, d, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("at"), "value", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("ord"))
    visible, playing = (r + o) % 4 != 0, (F.floor(r / 2) + o) % 3 == 0
    # DuckDB rounds where it makes a whole number of a fraction.
    score = folds.media_score(visible, playing, o == 1, F.rint("value").cast("long") * 4, o + 1, F.lit(2), F.col("at") % 2 == 0, F.lit(True))
    return folds.primary_medium(rows.select("media_id", "at", "ord", score.alias("score"), visible.alias("visible"), playing.alias("playing")))
