"""The registered queries: each operator family on the fixed tables, with the same result in SQL.

Stand-ins: files are documents, declarations are parts, conversations or orders with their lines, metrics are lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stats import round1
from ..operators import difference, graph, health, order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d, f=f: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def _files(t) -> DataFrame:
    return t("documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"), F.octet_length("text").cast("long").alias("size"), X.line_count(F.col("text")).alias("lines"), "lang", "source", "text")


FILES = "(select doc_id, source || '/' || lang || '/' || doc_id || '.txt' as path, strlen(text) as size, (length(text) - length(replace(text, chr(10), '')) + case when length(text) > 0 and not ends_with(text, chr(10)) then 1 else 0 end)::bigint as lines, lang, source, text from documents)"


def _metrics(t) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey", "l_linenumber", "l_partkey", F.floor("l_quantity").cast("long").alias("cyclomatic"), F.col("l_linenumber").cast("long").alias("nesting"), F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("params"), F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("body_lines"))


METRICS = "(select l_suppkey as file, l_orderkey, l_linenumber, l_partkey, floor(l_quantity)::bigint as cyclomatic, l_linenumber::bigint as nesting, floor(l_discount * 100::double + 0.5::double)::bigint as params, floor(l_extendedprice / 1000::double)::bigint as body_lines from lineitem)"


@_query(f"""select file, l_orderkey, l_linenumber, l_partkey, round(cyclomatic + 2.0::double * nesting + 0.5::double * params + body_lines / 20.0::double, 6) as score
from {METRICS} where cyclomatic >= 1 order by score desc, file, l_orderkey, l_linenumber, l_partkey limit 20""")
def k01_hotspots(t):
    m = _metrics(t)
    return health.hotspots(m, 20, ties=("file", "l_orderkey", "l_linenumber", "l_partkey")).select("file", "l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"))


@_query(f"""select count(*)::bigint as analyzed, floor(sum(cyclomatic)::double / count(*) * 10 + 0.5::double) / 10 as avg_complexity, max(cyclomatic)::bigint as max_complexity,
floor(sum(nesting)::double / count(*) * 10 + 0.5::double) / 10 as avg_nesting, floor(sum(params)::double / count(*) * 10 + 0.5::double) / 10 as avg_params, floor(sum(body_lines)::double / count(*) * 10 + 0.5::double) / 10 as avg_body_lines,
count(*) filter (cyclomatic >= 10)::bigint as high_count, floor(100.0::double * count(*) filter (cyclomatic >= 10) / count(*) * 10 + 0.5::double) / 10 as high_percent,
ceil((list_extract(list_sort(list(cyclomatic)), ((count(*) - 1) // 2 + 1)::bigint) + list_extract(list_sort(list(cyclomatic)), (count(*) // 2 + 1)::bigint)) / 2)::bigint as median,
list_extract(list_sort(list(cyclomatic)), floor((count(*) - 1) * 0.9::double)::bigint + 1)::bigint as p90 from {METRICS}""")
def k02_health(t):
    return health.health(_metrics(t))


@_query(f"""select file, count(*)::bigint as functions, floor(avg(cyclomatic) * 10 + 0.5::double) / 10 as avg_complexity, max(cyclomatic)::bigint as max_complexity
from {METRICS} group by file having count(*) >= 2 order by avg_complexity desc, file limit 5""")
def k03_hottest_files(t):
    return health.hottest_files(_metrics(t))


@_query("""select coalesce(source, '*') as source, coalesce(lang, '*') as lang, count(*)::bigint as files, sum(n_chars)::bigint as chars
from documents group by rollup (source, lang)""")
def k04_stats_rollup(t):
    g = t("documents").rollup("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    return g.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "files", "chars")


@_query(f"select source, count(*)::bigint as files, sum(ceil(size / 4.0::double))::bigint as tokens from {FILES} group by source")
def k05_token_estimate(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


@_query(f"select doc_id, lines from {FILES}")
def k06_line_count(t):
    return _files(t).select("doc_id", "lines")


@_query("""select doc_id, lang from documents where regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') order by doc_id limit 50""")
def k07_callers(t):
    return t("documents").where(X.has_word(F.col("text"), "the")).select("doc_id", "lang").orderBy("doc_id").limit(50)


def _score_sql(col: str, query: str) -> str:
    terms = query.split()
    parts = f"list_filter(regexp_split_to_array(regexp_replace({col}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[-_./]'), lambda x: x <> '')"
    direct = f"(case when contains({col}, '{query}') then 10 else 0 end + case when {col} = '{query}' then 20 else 0 end" + "".join(f" + case when contains({col}, '{x}') then 5 else 0 end + case when list_contains({parts}, '{x}') then 3 else 0 end" for x in terms) + ")"
    a = f"list_distinct(list_transform(range(1, length({col})), lambda i: substring({col}, i, 2)))"
    b = f"list_distinct(list_transform(range(1, length('{query}')), lambda i: substring('{query}', i, 2)))"
    sim = f"(2.0::double * len(list_intersect({a}, {b})) / greatest(len({a}) + len({b}), 1))"
    return f"(case when {direct} <> 0 then {direct} when {sim} > 0.4::double then floor(8 * {sim})::bigint else 0 end)::bigint"


@_query(f"select p_partkey, {_score_sql('lower(p_name)', 'small box')} as score from part")
def k08_score_match(t):
    return t("part").select("p_partkey", X.score_match(F.lower("p_name"), "small box").alias("score"))


@_query("""select p_name, round(2.0::double * len(list_intersect(a, b)) / greatest(len(a) + len(b), 1), 6) as similarity from
(select distinct p_name, list_distinct(list_transform(range(1, length(p_name)), lambda i: substring(p_name, i, 2))) as a,
 list_distinct(list_transform(range(1, length('green box')), lambda i: substring('green box', i, 2))) as b from part) order by similarity desc, p_name limit 20""")
def k09_bigram_similarity(t):
    return t("part").select("p_name").distinct().select("p_name", F.round(X.bigram_similarity(F.col("p_name"), F.lit("green box")), 6).alias("similarity")).orderBy(F.desc("similarity"), "p_name").limit(20)


@_query(r"""select name, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[-_./]'), lambda x: x <> ''), lambda x: lower(x)), '|') as parts
from (select distinct p_brand || '_' || replace(p_name, ' ', '-') || 'Item3DView' as name from part)""")
def k10_split_identifier(t):
    names = t("part").select(F.concat("p_brand", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("Item3DView")).alias("name")).distinct()
    return names.select("name", F.array_join(X.split_identifier(F.col("name")), "|").alias("parts"))


@_query(f"""select kind, id, score from (
select 'path' as kind, doc_id as id, 3 * {_score_sql('lower(path)', 'en src1')} as score from {FILES}
union all select 'decl', p_partkey, 3 * {_score_sql('lower(p_name)', 'en src1')} + 2 * {_score_sql("lower(p_brand || ' ' || p_type)", 'en src1')} from part) where score > 0 order by score desc, kind, id limit 20""")
def k11_ranked_search(t):
    q = "en src1"
    a = _files(t).select(F.lit("path").alias("kind"), F.col("doc_id").alias("id"), (3 * X.score_match(F.lower("path"), q)).alias("score"))
    b = t("part").select(F.lit("decl").alias("kind"), F.col("p_partkey").alias("id"), (3 * X.score_match(F.lower("p_name"), q) + 2 * X.score_match(F.lower(F.concat_ws(" ", "p_brand", "p_type")), q)).alias("score"))
    return a.unionByName(b).where("score > 0").orderBy(F.desc("score"), "kind", "id").limit(20)


@_query("select p_partkey, p_name, p_brand || ' ' || p_type as signature from part where contains(lower(p_name), 'e') and contains(lower(p_type), 'a') order by p_partkey limit 50")
def k12_lookup_symbol(t):
    p = t("part").where(F.contains(F.lower("p_name"), F.lit("e")) & F.contains(F.lower("p_type"), F.lit("a")))
    return p.select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type").alias("signature")).orderBy("p_partkey").limit(50)


@_query(f"select doc_id, path from {FILES} where regexp_matches(path, '^src1/[^/]*/1[^/]*\\.txt$')")
def k13_glob(t):
    return _files(t).where(F.regexp_like("path", F.lit(X.glob_regex("src1/*/1*.txt")))).select("doc_id", "path")


@_query(f"select doc_id, path from {FILES} where path = 'src2/en' or starts_with(path, 'src2/en/') or path = '7.txt' or ends_with(path, '/7.txt')")
def k14_prefix_and_suffix(t):
    p = F.col("path")
    return _files(t).where(X.under(p, "src2/en") | (p == "7.txt") | F.endswith(p, F.lit("/7.txt"))).select("doc_id", "path")


@_query("""select o_orderkey, 0 as line, 'order' as kind from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
union all select l_orderkey, l_linenumber, 'line' from lineitem where l_returnflag = 'R' and l_orderkey in (select o_orderkey from orders)""")
def k15_kind_filter_keeps_ancestors(t):
    o, m = t("orders"), t("lineitem").where("l_returnflag = 'R'")
    up = o.join(m, o.o_orderkey == m.l_orderkey, "left_semi").select("o_orderkey", F.lit(0).alias("line"), F.lit("order").alias("kind"))
    own = m.join(o, o.o_orderkey == m.l_orderkey, "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), F.lit("line").alias("kind"))
    return up.unionByName(own)


@_query("""select l_orderkey, count(*)::bigint as lines from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F') group by 1""")
def k16_private_subtrees_go(t):
    return t("lineitem").join(t("orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@_query("""select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey where contains(lower(o_orderpriority), 'urgent') or l_shipdate >= timestamp '1998-06-01'""")
def k17_symbol_filter(t):
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.where("contains(lower(o_orderpriority), 'urgent') or l_shipdate >= timestamp_ntz '1998-06-01'").select("o_orderkey", "l_linenumber", "l_partkey")


@_query(f"select path, row_number() over (order by string_split(path, '/'))::bigint as file_ord from {FILES}")
def k18_component_order(t):
    return order.numbered(_files(t).select("path"), [F.split("path", "/")], "file_ord")


@_query(f"""select doc_id, tokens, before from (select doc_id, tokens, coalesce(sum(tokens) over (partition by source order by importance, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before,
 sum(tokens) over (partition by source)::bigint as total from (select doc_id, source, ceil(size / 4.0::double)::bigint as tokens, 3 * length(lang) - lines // 100 as importance from {FILES})) where before >= total - 20000""")
def k19_budget_drop(t):
    f = _files(t).select("doc_id", "source", X.token_estimate(F.col("text")).alias("tokens"), (3 * F.length("lang") - F.floor(F.col("lines") / 100)).alias("importance"))
    f = order.running(f, ["source"], [F.col("importance"), F.col("doc_id")], "tokens", "before", "total")
    return f.where(F.col("before") >= F.col("total") - 20000).select("doc_id", "tokens", "before")


@_query(r"select doc_id, case when strlen(text) > 80 then regexp_replace(substring(split_part(text, chr(10), 1), 1, 80), '\.+$', '') || '...' else text end as doc from documents")
def k20_short_docs(t):
    return t("documents").select("doc_id", X.short_doc(F.col("text")).alias("doc"))


PATHS = r"(select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages)"
TAILS = "(select distinct regexp_extract(path, '([^/]+/[^/]+)$', 1) as cand from {PATHS})".replace("{PATHS}", PATHS)


@_query(f"select cand, path from {TAILS} h join {PATHS} p on ends_with(p.path, h.cand) where length(cand) >= 3")
def k21_suffix_resolution(t):
    paths = t("pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    return graph.suffix_matches(paths.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("cand")), paths)


@_query("select s_suppkey, c.n as customers from supplier join (select c_nationkey, count(*)::bigint as n from customer group by 1) c on s_nationkey = c_nationkey")
def k22_relationship_edges(t):
    c = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return t("supplier").join(c, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "customers")


@_query(r"""select distinct doc_id as id, name from (select doc_id, unnest(list_distinct(regexp_split_to_array(text, '[^A-Za-z0-9_]+'))) as name from documents)
where name in (select unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) from benchmark) and length(name) >= 3""")
def k23_type_references(t):
    names = t("benchmark").select(F.explode(F.split("text", "[^A-Za-z0-9_]+")).alias("name")).where("length(name) >= 3")
    return graph.word_references(t("documents").select(F.col("doc_id").alias("id"), "text"), names)


@_query("""select p_partkey, p_brand || '::' || p_name || case when k > 1 then '#' || k else '' end as symbol_id from (select *, row_number() over (partition by p_brand, p_name order by p_partkey) as k from part)""")
def k24_symbol_ids(t):
    return graph.symbol_ids(t("part"), "p_brand", "p_name", ["p_partkey"]).select("p_partkey", "symbol_id")


def _edges(t) -> DataFrame:
    return t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct().unionByName(t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct())


EDGES = "(select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem union all select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem)"


@_query(f"""with recursive e as {EDGES}, r(node, d) as (select 'p1', 0 union select e.dst, r.d + 1 from r join e on e.src = r.node where r.d < 2) select node, min(d)::int as distance from r group by 1""")
def k25_reachability(t):
    e = _edges(t)
    return graph.reachable(e, e.sparkSession.createDataFrame([("p1",)], "node string"), 2)


@_query(f"select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select src as node, 1 as o, 0 as i from {EDGES} union all select dst, 0, 1 from {EDGES}) group by 1")
def k26_nodes_and_degrees(t):
    e = _edges(t)
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@_query(r"""select type, role, count(*)::bigint as uses from (select unnest(regexp_split_to_array(p_type, ' ')) as type, 'producer' as role from part union all select unnest(regexp_split_to_array(p_name, ' ')), 'consumer' from part) group by 1, 2""")
def k27_type_flow(t):
    p = t("part")
    a = p.select(F.explode(F.split("p_type", " ")).alias("type"), F.lit("producer").alias("role"))
    return a.unionByName(p.select(F.explode(F.split("p_name", " ")).alias("type"), F.lit("consumer").alias("role"))).groupBy("type", "role").agg(F.count("*").alias("uses"))


@_query("""select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' else 'modified' end as change, o.sig as old_value, n.sig as new_value
from (select doc_id, source || n_chars as sig from documents where doc_id % 10 < 9) o full outer join (select doc_id, source || case when doc_id % 7 = 0 then n_chars + 1 else n_chars end as sig from documents where doc_id % 10 > 0) n on o.doc_id = n.doc_id
where o.sig is distinct from n.sig""")
def k28_structural_diff(t):
    d = t("documents")
    old = d.where("doc_id % 10 < 9").select("doc_id", F.concat("source", "n_chars").alias("sig"))
    new = d.where("doc_id % 10 > 0").select("doc_id", F.expr("source || case when doc_id % 7 = 0 then n_chars + 1 else n_chars end").alias("sig"))
    return difference.structural_diff(old, new, ["doc_id"], "sig")


@_query("select conv_id, role, arg_max(text, turn) as text from conversations group by 1, 2")
def k29_last_wins(t):
    return difference.last_wins(t("conversations"), ["conv_id", "role"], "text", "turn")


@_query("""select doc_id, (case when lower(source) = 'src1' then 100 when contains(lower(source), 'src1') then 50 else 0 end + case when contains(lower(text), 'the of') then 20 else 5 * (case when contains(lower(text), 'the') then 1 else 0 end + case when contains(lower(text), 'of') then 1 else 0 end) end)::bigint as score
from documents order by score desc, doc_id limit 5""")
def k30_wiki_search(t):
    s, x = F.lower("source"), F.lower("text")
    hit = lambda w: F.when(F.contains(x, F.lit(w)), 1).otherwise(0)
    score = F.when(s == "src1", 100).when(F.contains(s, F.lit("src1")), 50).otherwise(0) + F.when(F.contains(x, F.lit("the of")), 20).otherwise(5 * (hit("the") + hit("of")))
    return t("documents").select("doc_id", score.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(5)


@_query(r"""select item_id, 10 * len(list_filter(regexp_split_to_array(trim(lower(text)), '\s+'), lambda w: strlen(w) >= 4 and contains('that with from this which', w)))::bigint as score from benchmark""")
def k31_score_pages(t):
    words = F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda w: (F.octet_length(w) >= 4) & F.contains(F.lit("that with from this which"), w))
    return t("benchmark").select("item_id", (10 * F.size(words)).cast("long").alias("score"))


@_query("""select source, count(*)::bigint as files, count(l.doc_id)::bigint as covered, (count(*) - count(l.doc_id))::bigint as uncovered, round(100.0::double * count(l.doc_id) / count(*), 6) as percent
from documents d left join (select distinct doc_id from labels) l using (doc_id) group by source""")
def k32_coverage(t):
    lab = t("labels").select("doc_id", F.lit(1).alias("c")).distinct()
    g = t("documents").select("doc_id", "source").join(lab, "doc_id", "left").groupBy("source").agg(F.count("*").alias("files"), F.count("c").alias("covered"))
    return g.select("source", "files", "covered", (F.col("files") - F.col("covered")).alias("uncovered"), F.round(100.0 * F.col("covered") / F.col("files"), 6).alias("percent"))


@_query(f"""select string_split(path, '/')[1] || '/' || string_split(path, '/')[2] as grp, count(*)::bigint as files, sum(lines)::bigint as lines, sum(size)::bigint as bytes from {FILES} group by 1""")
def k33_preflight_groups(t):
    parts = F.split("path", "/")
    return _files(t).groupBy(F.concat_ws("/", parts[0], parts[1]).alias("grp")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"))


@_query("select min(doc_id) as doc_id, n_chars from documents group by text, n_chars")
def k34_first_wins(t):
    # grouped by a hash of the text: equal texts meet without the texts being shuffled
    return t("documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h")).groupBy("h", "n_chars").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "n_chars")


@_query("select conv_id, count(*) filter (role = 'user')::bigint as open, count(*)::bigint as total from conversations group by 1")
def k35_unresolved_counts(t):
    return t("conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("open"), F.count("*").alias("total"))


@_query(r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, (select count(*) from unnest(string_split(html, chr(10))) u(l) where regexp_matches(l, '<(article|nav|section|header|footer|main|h1)'))::bigint as tag_lines from pages""")
def k36_html_extract(t):
    lines = F.filter(F.split("html", "\n"), lambda x: F.regexp_like(x, F.lit("<(article|nav|section|header|footer|main|h1)")))
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(lines).cast("long").alias("tag_lines"))


@_query("""select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages""")
def k37_links(t):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@_query("""select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as parent from conversations""")
def k38_nearest_heading(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t("conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("parent"))


@_query("""select page_id, min(href) as first_import from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages) where contains(href, 'the') group by 1""")
def k39_imported_by(t):
    h = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return h.where(F.contains("href", F.lit("the"))).groupBy("page_id").agg(F.min("href").alias("first_import"))


@_query("""select doc_id, reason from (select doc_id, case when lang = 'fr' then 'same_file' when contains(source, '7') then 'test_file' when n_chars < 300 then 'name_convention' end as reason from documents) where reason is not null
order by case reason when 'same_file' then 0 when 'test_file' then 1 else 2 end, doc_id limit 20""")
def k40_related_tests(t):
    reason = F.when(F.col("lang") == "fr", "same_file").when(F.contains("source", F.lit("7")), "test_file").when(F.col("n_chars") < 300, "name_convention")
    rank = F.when(F.col("reason") == "same_file", 0).when(F.col("reason") == "test_file", 1).otherwise(2)
    return t("documents").select("doc_id", reason.alias("reason")).where("reason is not null").orderBy(rank, "doc_id").limit(20)


@_query("""select p_name, min(p_partkey) as p_partkey from part group by 1 having count(*) = 1 union all select p_brand || p_type || p_size || p_name, min(p_partkey) from part group by 1 having count(*) = 1""")
def k41_unique_match(t):
    one = lambda df, c: df.groupBy(F.col(c).alias("p_name")).agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n")).where("n = 1").drop("n")
    return one(t("part"), "p_name").unionByName(one(t("part").select("p_partkey", F.concat("p_brand", "p_type", "p_size", "p_name").alias("x")), "x"))


@_query("select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) as source_lines from documents")
def k42_read_lines(t):
    return t("documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n").alias("source_lines"))


@_query("""select user_id, event_id, (sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) % 2)::bigint as inside from events""")
def k43_fence_parity(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("user_id", "event_id", (F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w) % 2).alias("inside"))


@_query("""select user_id, count(*)::bigint as sessions from (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as prev from events) where prev is null or ts > prev + interval '30' minute group by 1""")
def k44_idle_sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").select("user_id", "ts", F.lag("ts").over(w).alias("prev"))
    return e.where("prev is null or ts > prev + interval '30' minute").groupBy("user_id").agg(F.count("*").alias("sessions"))


@_query("""select state, count(*)::bigint as files from (select case when c.doc_id is null then 'pruned' when o.doc_id is null then 'miss' when o.size = c.size then 'hit' else 'miss' end as state
from (select doc_id, strlen(text) as size from documents where doc_id % 5 > 0) c full outer join (select doc_id, strlen(text) + case when doc_id % 3 = 0 then 1 else 0 end as size from documents where doc_id % 5 < 4) o using (doc_id)) group by 1""")
def k45_cache_states(t):
    d = t("documents").select("doc_id", F.octet_length("text").alias("size"))
    now = d.where("doc_id % 5 > 0").select("doc_id", F.col("size").alias("now"))
    old = d.where("doc_id % 5 < 4").select("doc_id", F.expr("size + case when doc_id % 3 = 0 then 1 else 0 end").alias("old"))
    state = F.when(F.col("now").isNull(), "pruned").when(F.col("old").isNull(), "miss").when(F.col("now") == F.col("old"), "hit").otherwise("miss")
    return now.join(old, "doc_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("files"))


@_query("select p_partkey, '[' || p_partkey || ',\"' || p_brand || '\",' || p_size || ']' as compact from part")
def k46_compact_rows(t):
    return t("part").select("p_partkey", F.format_string('[%d,"%s",%d]', "p_partkey", "p_brand", "p_size").alias("compact"))


@_query(f"""select coalesce(list_filter(string_split(path, '/'), lambda x: x in ('src3', 'de', 'fr'))[1], 'none') as flag, count(*)::bigint as files from {FILES} group by 1""")
def k47_suspicious_dirs(t):
    flag = F.coalesce(F.get(F.filter(F.split("path", "/"), lambda x: x.isin("src3", "de", "fr")), F.lit(0)), F.lit("none"))
    return _files(t).groupBy(flag.alias("flag")).agg(F.count("*").alias("files"))


@_query("""select conv_id, count(*) filter (role = 'user')::bigint as users, count(*) filter (role = 'assistant')::bigint as assistants, count(*) filter (role not in ('user', 'assistant'))::bigint as others from conversations group by 1""")
def k48_file_summary(t):
    n = lambda c: F.count_if(c)
    r = F.col("role")
    return t("conversations").groupBy("conv_id").agg(n(r == "user").alias("users"), n(r == "assistant").alias("assistants"), n(~r.isin("user", "assistant")).alias("others"))


__all__ = ["ORACLES", "QUERIES", "round1"]
