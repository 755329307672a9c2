"""Scalar functions over the tables, and the relational operators of Spark that complete the set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import BULLET, PAGE_NUMBERS, canonical_json, citation_indices, clean_by_kind, clean_prose, human_size, is_email, is_given, is_page_number, is_strong_password, is_url, is_uuid, looks_like_heading, looks_like_list_item, looks_like_table_row, merged_lines, preview, safe_file_name, support_score, within
from quern.plans.common import r6, read

HEDGES = ("may be", "i think", "probably")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(clean_prose("text")).alias("cleaned_md5"))


def date_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month arithmetic keeps to the month's end; differences are absolute, with a flag for the future."""
    o = read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    diff = F.datediff(F.lit("1996-01-01").cast("date"), "d")
    return o.select("o_orderkey", F.add_months("d", 1).cast("string").alias("next_month"), F.date_add("d", 45).cast("string").alias("plus_45"), F.dayofweek("d").alias("weekday"), F.date_format("d", "yyyy/MM").alias("month"), F.abs(diff).alias("days"), (diff < 0).alias("is_future"))


def time_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in another zone, with the offset between both, and how far from a time they are in days, hours, minutes and seconds."""
    there = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.col("ts"))
    apart = F.abs(F.unix_seconds(F.lit("2024-01-15").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")))
    day, hour, minute = (F.floor(apart / n).cast("long") for n in (86_400, 3_600, 60))
    offset = F.round((F.unix_micros(there.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000, 2)
    return read(spark, sf_dir, "events").select("event_id", F.date_format(there, "yyyy-MM-dd HH:mm:ss").alias("there"), offset.alias("hours_ahead"), F.date_format(there, "EEEE").alias("weekday"), day.alias("days"), (hour % 24).alias("hours"), (minute % 60).alias("minutes"), (apart % 60).alias("seconds"))


def math_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(F.sqrt(v)).alias("root"), r6(F.ln(v)).alias("ln"), r6(F.log10(v)).alias("log10"), r6(F.pow(F.col("l_discount"), 2)).alias("square"), r6(F.sin(F.col("l_quantity"))).alias("sin"), r6(F.cos(F.col("l_quantity"))).alias("cos"), r6(F.tan(F.col("l_quantity"))).alias("tan"), r6(F.exp(F.col("l_discount"))).alias("exp"), r6(F.pi() * F.col("l_tax") + F.e()).alias("line"), r6(F.abs(F.col("l_tax") - 0.05)).alias("gap"))


def string_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), preview("text").alias("preview"))


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", is_url("url").alias("url_ok"), is_email(F.concat(F.lit("a@"), F.regexp_extract("url", "//([^/]+)", 1))).alias("email_ok"), F.length("html").between(100, 5000).alias("length_ok"), safe_file_name("url").alias("file_name"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the user's turns cited by number: indices found, and the support score."""
    t = read(spark, sf_dir, "conversations")
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" ["), F.col("turn").cast("string"), F.lit("] (2) [2]"))).otherwise(F.lit("")))
    return t.where("role = 'assistant' or turn % 3 = 0").select("conv_id", "turn", F.array_join(F.transform(citation_indices(text), lambda x: x.cast("string")), ",").alias("cited"), r6(support_score(text, F.col("turn"), HEDGES)).alias("support"))


def json_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("packed"))


def canonical_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope keys as JSON with their names in order, whatever the order in which they were given."""
    m = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).otherwise(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return read(spark, sf_dir, "documents").groupBy(canonical_json(m).alias("scope")).agg(F.count("*").alias("n"))


def text_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned by the profile of a kind of file, with broken lines joined, and what their lines look like."""
    kind = F.get(F.array(F.lit("py"), F.lit("md"), F.lit("txt")), (F.col("doc_id") % 3).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    count = lambda test: F.size(F.filter(lines, lambda x: test(F.trim(x))))
    return d.select("doc_id", F.md5(clean_by_kind("text", kind)).alias("cleaned_md5"), F.length(merged_lines("text")).alias("merged_chars"), count(looks_like_heading).alias("headings"), count(looks_like_list_item).alias("items"), count(looks_like_table_row).alias("table_rows"), count(is_page_number).alias("page_numbers"))


def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of customers' fields."""
    c = read(spark, sf_dir, "customer")
    uuid = F.concat(F.lit("123e4567-e89b-42d3-a456-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return c.select("c_custkey", is_given("c_name").alias("given"), within("c_acctbal", 0, 5000).alias("in_range"), is_uuid(F.when(F.col("c_custkey") % 2 == 0, uuid).otherwise("no")).alias("uuid_ok"), is_strong_password(F.concat("c_name", F.lit("a"))).alias("strong"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("choice_ok"), human_size(F.abs(F.col("c_acctbal")) * 1000).alias("size"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("both", c.intersect(s)), ("either", c.union(s).distinct()), ("customers_only", c.exceptAll(s)), ("both_all", c.intersectAll(s))]
    out = None
    for name, df in parts:
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def part_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"), F.grouping_id().alias("grain"))


def nation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(by).alias("nth"), F.lag("o_orderkey").over(by).alias("before"), F.round(F.sum("o_totalprice").over(by.rowsBetween(-2, 0)), 2).alias("last_three"), F.ntile(4).over(by).alias("quarter"))


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), r6(F.percentile("l_quantity", F.lit(0.5))).alias("median_qty"), F.countDistinct("l_suppkey").alias("suppliers"))


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join: parts and the price bands they fall into; the bands are ten rows."""
    bands = spark.createDataFrame([(i, 250.0 * i, 250.0 * (i + 1)) for i in range(10)], "band int, low double, high double")
    p = read(spark, sf_dir, "part")
    return p.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("low")) & (F.col("p_retailprice") < F.col("high"))).groupBy("band").agg(F.count("*").alias("parts"))


QUERIES = {f.__name__: f for f in (clean_text, text_profiles, time_zones, canonical_scopes, field_checks, date_ops, math_ops, string_helpers, validators, citations, json_ops, set_operations, part_cube, nation_rollup, order_windows, price_quantiles, price_bands)}
_TRIMMED = r"list_transform(string_split(t, chr(10)), lambda x: trim(x, ' '))"
_HEADING = r"(length(x) <= 60 and not regexp_matches(x, '[.!?。！？；;:：]$') and regexp_matches(x, '^(?i:chapter|section|appendix)\b|^\d+(?:\.\d+){0,5}\s+\S+|^第[一二三四五六七八九十0-9]+(?:章|节|部分|条)|^[A-Z0-9][A-Z0-9 _./:-]{2,}$'))"
_ITEM = f"regexp_matches(x, '{BULLET}')"
_ROW = r"regexp_matches(x, '[|\t]|\S+\s{2,}\S+')"
_NUMBER = "(length(x) <= 80 and (" + " or ".join(f"regexp_matches(x, '{p}')" for p in PAGE_NUMBERS) + "))"
_OF = lambda test: f"len(list_filter(l, lambda x: {test}))::int"
ORACLE = {
    "text_profiles": rf"""with t as (select doc_id, coalesce(text, '') as t from documents), l as (select doc_id, t, {_TRIMMED} as l, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') as b from t),
        m as (select doc_id, list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')) as c, list_transform(string_split(b, chr(10)), lambda x: rtrim(replace(x, chr(9), '    '), ' ')) as s from l),
        c as (select doc_id, case doc_id % 3 when 0 then regexp_replace(regexp_replace(array_to_string(list_transform(s, lambda x: regexp_extract(x, '^ *', 0) || regexp_replace(ltrim(x, ' '), '[ \t]{{2,}}', ' ', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')
            else regexp_replace(trim(regexp_replace(array_to_string(case doc_id % 3 when 1 then c else list_filter(c, lambda x, i: i = 1 or not (x = c[i - 1] and (length(x) >= 3 or x = ''))) end, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' '), '^\n+|\n+$', '', 'g') end as cleaned from m),
        u as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from l), f as (select *, {_HEADING} or {_ITEM} or {_ROW} as fixed from u),
        p as (select doc_id, i, x, fixed, lag(x) over w as p, lag(fixed) over w as pf from f window w as (partition by doc_id order by i)),
        j as (select *, p <> '' and x <> '' and not pf and not fixed and not regexp_matches(p, '[.!?。！？；;:：]$') and case when regexp_matches(p, '[-‐‑]$') then regexp_matches(x, '^[A-Za-z0-9]') else regexp_matches(p, '[,，、/／(（]$') or regexp_matches(x, '^[),，。；;:：!?！？」』】）\]]') or regexp_matches(x, '^[a-z一-鿿“"‘（(]') or length(p) < 90 end as joined from p),
        g as (select doc_id, string_agg(case when i = 1 then '' when not joined then chr(10) when regexp_matches(p, '[-‐‑]$') then chr(1) when regexp_matches(p, '[(（/／]$') or regexp_matches(x, '^[),，。；;:：!?！？」』】）\]]') then '' else ' ' end || x, '' order by i) as t from j group by 1)
        select doc_id, md5(cleaned) as cleaned_md5, length(regexp_replace(regexp_replace(regexp_replace(g.t, '[-‐‑]\x01', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'))::int as merged_chars,
            {_OF(_HEADING)} as headings, {_OF(_ITEM)} as items, {_OF(_ROW)} as table_rows, {_OF(_NUMBER)} as page_numbers from l join c using (doc_id) join g using (doc_id)""",
    "clean_text": r"""with a as (select doc_id, list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')) as l from documents),
        b as (select doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 or not (x = l[i - 1] and (length(x) >= 3 or x = ''))), chr(10)) as t from a)
        select doc_id, md5(regexp_replace(trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' '), '^\n+|\n+$', '', 'g')) as cleaned_md5 from b""",
    "time_zones": "with e as (select event_id, ts, ts + interval 8 hour as t, abs(epoch(timestamp '2024-01-15')::bigint - floor(epoch(ts))::bigint) as a from events) select event_id, strftime(t, '%Y-%m-%d %H:%M:%S') as there, 8.0::double as hours_ahead, dayname(t) as weekday, a // 86400 as days, a // 3600 % 24 as hours, a // 60 % 60 as minutes, a % 60 as seconds from e",
    "canonical_scopes": "select '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' as scope, count(*) as n from documents group by 1",
    "field_checks": "select c_custkey, coalesce(trim(c_name) <> '', false) as given, c_acctbal between 0 and 5000 as in_range, c_custkey % 2 = 0 as uuid_ok, regexp_matches(c_name, '[A-Z]') and regexp_matches(c_name, '[0-9]') and length(c_name) >= 7 as strong, c_mktsegment in ('BUILDING', 'MACHINERY') as choice_ok, case when abs(c_acctbal) * 1000 < 1024 then printf('%.2f B', abs(c_acctbal) * 1000) when abs(c_acctbal) * 1000 < 1048576 then printf('%.2f KB', abs(c_acctbal) * 1000 / 1024) else printf('%.2f MB', abs(c_acctbal) * 1000 / 1048576) end as size from customer",
    "date_ops": "with o as (select o_orderkey, o_orderdate::date as d from orders) select o_orderkey, (d + interval 1 month)::date::varchar as next_month, (d + 45)::varchar as plus_45, (dayofweek(d) + 1)::int as weekday, strftime(d, '%Y/%m') as month, abs(date '1996-01-01' - d)::int as days, date '1996-01-01' - d < 0 as is_future from o",
    "math_ops": "select l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) as root, round(ln(l_extendedprice), 6) as ln, round(log10(l_extendedprice), 6) as log10, round(pow(l_discount, 2), 6) as square, round(sin(l_quantity), 6) as sin, round(cos(l_quantity), 6) as cos, round(tan(l_quantity), 6) as tan, round(exp(l_discount), 6) as exp, round(pi() * l_tax + exp(1.0::double), 6) as line, round(abs(l_tax - 0.05::double), 6) as gap from lineitem",
    "string_helpers": "select doc_id, md5(text) as md5, sha256(text) as sha256, case when length(text) > 50 then text[1:50] || '...' else text end as preview from documents",
    "validators": r"select page_id, regexp_matches(url, '^https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s]*)?$') as url_ok, regexp_matches('a@' || regexp_extract(url, '//([^/]+)', 1), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') as email_ok, length(html) between 100 and 5000 as length_ok, regexp_replace(url, '[<>:\"/\\|?*\x00-\x1f]', '_', 'g') as file_name from pages",
    "citations": r"""with t as (select conv_id, turn, text || case when turn % 3 = 0 then ' [' || turn || '] (2) [2]' else '' end as t from conversations where role = 'assistant' or turn % 3 = 0),
        u as (select *, len(regexp_extract_all(t, '\[(\d+)\]', 1)) as n, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\[(\d+)\]', 1) || regexp_extract_all(t, '\((\d+)\)', 1), lambda x: x::int))) as c from t)
        select conv_id, turn, array_to_string(c, ',') as cited, round(1 - case when n = 0 then 0.3 else 0 end - case when turn = 0 or n / turn < 0.5 then 0.2 else 0 end - case when contains(t, 'may be') or contains(t, 'i think') or contains(t, 'probably') then 0.2 else 0 end, 6)::double as support from u""",
    "json_ops": "select event_id, (props->>'$.k')::int as k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' as packed from events",
    "set_operations": "with c as (select c_nationkey as k from customer), s as (select s_nationkey as k from supplier) select 'both' as part, count(*) as n from (select k from c intersect select k from s) union all select 'either', count(*) from (select k from c union select k from s) union all select 'customers_only', count(*) from (select k from c except all select k from s) union all select 'both_all', count(*) from (select k from c intersect all select k from s)",
    "part_cube": "select p_brand, p_size, count(*) as n, round(avg(p_retailprice), 4) as avg_price, grouping_id(p_brand, p_size) as grain from part group by cube (p_brand, p_size)",
    "nation_rollup": "select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "order_windows": "select o_orderkey, row_number() over w::int as nth, lag(o_orderkey) over w as before, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last_three, ntile(4) over w::int as quarter from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "price_quantiles": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price, round(quantile_cont(l_quantity, 0.5), 6) as median_qty, count(distinct l_suppkey) as suppliers from lineitem group by 1, 2",
    "price_bands": "select floor(p_retailprice / 250)::int as band, count(*) as parts from part where p_retailprice >= 0 and p_retailprice < 2500 group by 1",
}
