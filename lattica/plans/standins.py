"""An index made of the fixed tables, for the library's functions to run on: the same columns as extracted ones.

A customer's orders are the top-level declarations of a file, their lines the children; each order is an import of
another customer's file. The SQL below gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PATH = "concat('m', c % 3, '/n', c % 25, '/c', c, case c % 4 when 0 then '.rs' when 1 then '.py' when 2 then '.ts' else '_test.go' end)"


#: Of the raw columns of an order (top) or a line, and of the path: so a filter of languages goes below the windows.
_COLUMNS = {
    "language": "case when endswith(path, '.rs') then 'Rust' when endswith(path, '.py') then 'Python' when endswith(path, '.ts') then 'TypeScript' else 'Go' end",
    "kind": "case when top then case when status = 'P' then 'Trait' else 'Struct' end when flag = 'N' then 'Field' else 'Method' end",
    "name": "case when top then concat('Order', k % 500) else concat(case when n = 7 then 'test_' else 'get_' end, 'part', a % 300) end",
    "signature": "case when top then concat(case when status = 'P' then 'trait ' else 'struct ' end, 'Order', k % 500) when flag = 'N' then concat('part', a % 300, ': Order', a % 500) else concat('fn get(a: Order', a % 500, ', b: u32) -> Order', b % 500) end",
    "visibility": "case when top then case status when 'F' then 'Private' when 'O' then 'Public' else 'PublicCrate' end when status = 'F' then 'Private' else 'Public' end",
    "doc_comment": "case when top and k % 4 = 0 then concat('Keeps ', priority, ' rows.\n', repeat('More of Order. ', cast(k % 9 as int))) end",
    "is_test": "case when top then false else n = 7 end", "is_deprecated": "case when top then false else n = 6 end",
    "body_lines": "case when flag <> 'N' then cast(floor(price / 1000) as bigint) end", "cyclomatic": "case when flag <> 'N' then cast(floor(quantity) as bigint) end",
    "nesting": "case when flag <> 'N' then cast(n as bigint) end", "params": "case when flag <> 'N' then cast(floor(discount * 100 + 0.5) as bigint) end",
    "relationships": "case when top and k % 3 = 0 then array(concat('implements Order', (k * 7) % 500)) else cast(array() as array<string>) end",
}


def decls(t) -> DataFrame:
    """Keys and numbers are shuffled, sorted and counted; texts are made of them afterwards."""
    o = t("orders").selectExpr(
        "true as top", "o_custkey as c", "o_orderkey as k", "0 as n", "0L as a", "0L as b", "0d as price", "o_orderstatus as status", "o_orderpriority as priority",
        "cast(null as string) as flag", "cast(null as double) as quantity", "cast(null as double) as discount",
    )
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "false as top", "o_custkey as c", "l_orderkey as k", "l_linenumber as n", "l_partkey as a", "l_suppkey as b", "l_extendedprice as price", "l_linestatus as status", "cast(null as string) as priority",
        "l_returnflag as flag", "l_quantity as quantity", "l_discount as discount",
    )
    d = o.unionByName(lines).withColumn("path", F.expr(_PATH))
    ties = ["k", "n", "a", "b", "price"]
    d = d.withColumn("decl_ord", F.row_number().over(Window.partitionBy("path").orderBy(*ties)) - 1)
    own = Window.partitionBy("path", "k")
    d = d.withColumn("first_ord", F.min("decl_ord").over(own)).withColumn("last_ord", F.max("decl_ord").over(own))
    d = d.withColumn("parent_ord", F.when(F.col("n") > 0, F.col("first_ord"))).withColumn("depth", F.when(F.col("n") > 0, 1).otherwise(0))
    d = d.withColumn("subtree_end", F.when(F.col("n") > 0, F.col("decl_ord")).otherwise(F.col("last_ord"))).withColumn("line", F.col("decl_ord") + 1)
    d = d.withColumns({"member": F.substring_index("path", "/", 1), **{name: F.expr(e) for name, e in _COLUMNS.items()}})
    return d.select("member", "path", "language", "decl_ord", "parent_ord", "depth", "subtree_end", "kind", "name", "signature", "visibility", "line", "doc_comment", "is_test", "is_deprecated", "body_lines", "cyclomatic", "nesting", "params", "relationships")


_SQL_PATH = _PATH.replace("concat('m', c % 3, '/n', c % 25, '/c', c, ", "('m' || c % 3 || '/n' || c % 25 || '/c' || c || ")
_RAW = f"""(select *, {_SQL_PATH} as path, 'm' || c % 3 as member from (
 select o_custkey as c, o_orderkey as k, 0 as n, 0::bigint as a, 0::bigint as b, 0::double as price, case when o_orderstatus = 'P' then 'Trait' else 'Struct' end as kind, 'Order' || o_orderkey % 500 as name,
  case when o_orderstatus = 'P' then 'trait ' else 'struct ' end || 'Order' || o_orderkey % 500 as signature, case o_orderstatus when 'F' then 'Private' when 'O' then 'Public' else 'PublicCrate' end as visibility,
  case when o_orderkey % 4 = 0 then 'Keeps ' || o_orderpriority || ' rows.' || chr(10) || repeat('More of Order. ', (o_orderkey % 9)::int) end as doc_comment, false as is_test, false as is_deprecated,
  null::bigint as body_lines, null::bigint as cyclomatic, null::bigint as nesting, null::bigint as params, case when o_orderkey % 3 = 0 then ['implements Order' || (o_orderkey * 7) % 500] else []::varchar[] end as relationships from orders
 union all select o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_returnflag = 'N' then 'Field' else 'Method' end, case when l_linenumber = 7 then 'test_' else 'get_' end || 'part' || l_partkey % 300,
  case when l_returnflag = 'N' then 'part' || l_partkey % 300 || ': Order' || l_partkey % 500 else 'fn get(a: Order' || l_partkey % 500 || ', b: u32) -> Order' || l_suppkey % 500 end,
  case when l_linestatus = 'F' then 'Private' else 'Public' end, null, l_linenumber = 7, l_linenumber = 6, case when l_returnflag <> 'N' then floor(l_extendedprice / 1000::double)::bigint end, case when l_returnflag <> 'N' then floor(l_quantity)::bigint end,
  case when l_returnflag <> 'N' then l_linenumber::bigint end, case when l_returnflag <> 'N' then floor(l_discount * 100::double + 0.5::double)::bigint end, []::varchar[] from lineitem join orders on l_orderkey = o_orderkey) x)"""
DECLS = f"""(select member, path, case c % 4 when 0 then 'Rust' when 1 then 'Python' when 2 then 'TypeScript' else 'Go' end as language, decl_ord, case when n > 0 then first_ord end as parent_ord, case when n > 0 then 1 else 0 end as depth,
 case when n > 0 then decl_ord else last_ord end as subtree_end, kind, name, signature, visibility, decl_ord + 1 as line, doc_comment, is_test, is_deprecated, body_lines, cyclomatic, nesting, params, relationships
 from (select *, min(decl_ord) over (partition by path, k) as first_ord, max(decl_ord) over (partition by path, k) as last_ord from (select *, row_number() over (partition by path order by k, n, a, b, price) - 1 as decl_ord from {_RAW} r) s) u)"""


def files(t) -> DataFrame:
    return files_of(decls(t))


def files_of(d: DataFrame) -> DataFrame:
    return d.groupBy("member", "path", "language").agg(F.count("*").alias("lines"), F.sum(F.octet_length("signature") + 1).alias("size"))


FILES = f"(select member, path, language, count(*)::bigint as lines, sum(strlen(signature) + 1)::bigint as size from {DECLS} d group by 1, 2, 3)"


def imports(t) -> DataFrame:
    o = t("orders").selectExpr("o_custkey as c", "o_orderkey as k", "o_orderkey % 1500 as to").withColumn("path", F.expr(_PATH)).withColumn("member", F.concat(F.lit("m"), F.col("c") % 3))
    o = o.withColumn("import_ord", F.row_number().over(Window.partitionBy("path").orderBy("k")) - 1)
    return o.selectExpr("member", "path", "import_ord", "concat('use crate::n', to % 25, '::c', to, '::Thing;') as text")


IMPORTS = f"(select member, path, row_number() over (partition by path order by k) - 1 as import_ord, 'use crate::n' || dst % 25 || '::c' || dst || '::Thing;' as text from (select o_custkey as c, o_orderkey as k, o_orderkey % 1500 as dst, {_SQL_PATH} as path, 'm' || c % 3 as member from orders) o)"


def contents(t) -> DataFrame:
    """A file's text: the signatures of its declarations, one a line, children in the braces of their parents."""
    d = decls(t)
    line = F.when(F.col("depth") > 0, F.concat(F.lit("  "), "signature", F.lit(" { { x } }"))).otherwise(F.concat("signature", F.lit(" {")))
    return d.groupBy("member", "path", "language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decl_ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


CONTENTS = f"(select member, path, language, string_agg(case when depth > 0 then '  ' || signature || ' {{ {{ x }} }}' else signature || ' {{' end, chr(10) order by decl_ord) as text from {DECLS} d group by 1, 2, 3)"


def pages(t) -> DataFrame:
    """A wiki of documents: operators.wiki.PAGE but for the structs' other fields."""
    d = t("documents").withColumn("w", F.split("text", " "))
    path = lambda c: _PATH.replace("c % ", f"({c}) % ").replace(", c,", f", {c},").replace("case c ", f"case {c} ")
    word = lambda i: f"get(w, {i})"
    return d.selectExpr(
        "doc_id as page_ord", "concat('p', doc_id) as id", "array_join(slice(w, 1, 4), ' ') as title", "case lang when 'en' then 'topic' when 'fr' then 'module' when 'de' then 'index' else 'entity' end as page_type",
        f"array({path('doc_id % 1500')}, {path('(doc_id * 7) % 1500')}) as source_files", f"array(concat('fn:', {word(5)}), concat('struct:', {word(6)})) as covers",
        "case when doc_id % 2 = 0 then array(struct('d' as description, case when doc_id % 3 = 0 then null else 'x' end as resolved_at)) else array() end as contradictions",
        f"case when doc_id % 5 = 0 then array(struct('quiet' as symptom, 'x' as resolved_at), struct(concat({word(7)}, ' ', {word(8)}) as symptom, cast(null as string) as resolved_at)) else array() end as failures", "text as content",
    )


def _sql_path(c: str) -> str:
    return f"('m' || ({c}) % 3 || '/n' || ({c}) % 25 || '/c' || ({c}) || case ({c}) % 4 when 0 then '.rs' when 1 then '.py' when 2 then '.ts' else '_test.go' end)"


PAGES = f"""(select doc_id as page_ord, 'p' || doc_id as id, array_to_string(w[1:4], ' ') as title, case lang when 'en' then 'topic' when 'fr' then 'module' when 'de' then 'index' else 'entity' end as page_type,
 [{_sql_path('doc_id % 1500')}, {_sql_path('(doc_id * 7) % 1500')}] as source_files, ['fn:' || w[6], 'struct:' || w[7]] as covers, case when doc_id % 2 = 0 then 1 else 0 end as contradictions, case when doc_id % 2 = 0 and doc_id % 3 = 0 then 1 else 0 end as open_contradictions,
 case when doc_id % 5 = 0 then 2 else 0 end as failures, case when doc_id % 5 = 0 then 1 else 0 end as open_failures, case when doc_id % 5 = 0 then w[8] || ' ' || w[9] end as symptom, text as content from (select *, string_split(text, ' ') as w from documents) x)"""
