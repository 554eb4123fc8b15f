"""Queries of the library's functions on the stand-in index, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget, difference, graph, health, order, preflight, search, trees, types
from ..storage import saved
from . import standins as S
from .registry import ORACLES, QUERIES

D, FI, IM, CO = S.DECLS, S.FILES, S.IMPORTS, S.CONTENTS


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d, f=f: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        ORACLES[f.__name__] = sql.strip()
        return f

    return add


_P = "string_split(path, '/')"


@_query(f"select path, decl_ord, name from {D} d where contains(lower(name), 'part29') order by {_P}, decl_ord limit 50")
def i01_lookup_symbol(t):
    return search.lookup_symbol(S.decls(t), "PART29").select("path", "decl_ord", "name")


@_query(f"select path, decl_ord, signature from {D} d where contains(lower(signature), 'order77,') order by {_P}, decl_ord limit 20")
def i02_search_signatures(t):
    return search.search_signatures(S.decls(t), "Order77,").select("path", "decl_ord", "signature")


@_query(f"""with d as {D}, top as (select * from d where lower(name) = 'order42' order by {_P}, decl_ord limit 10)
select top.path, top.decl_ord, top.kind, (select string_agg(kind || '=' || n, ',' order by kind) from (select c.kind, count(*) as n from d c where c.path = top.path and c.parent_ord = top.decl_ord group by 1)) as children from top""")
def i03_explain_symbol(t):
    e = search.explain_symbol(S.decls(t), "order42")
    return e.select("path", "decl_ord", "kind", F.when(F.col("children").isNotNull(), F.array_join(F.transform(F.map_entries("children"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")).alias("children"))


@_query(f"select path, decl_ord, name from {D} d where visibility = 'Public' and starts_with(path, 'm1/n1') order by {_P}, decl_ord limit 100")
def i04_public_api(t):
    return search.public_api(S.decls(t), "m1/n1").select("path", "decl_ord", "name")


@_query(f"with d as {D} select decl_ord, kind, name, line, nullif((select count(*) from d c where c.path = d.path and c.parent_ord = d.decl_ord), 0)::bigint as children from d where path = 'm0/n0/c300.rs' and depth = 0")
def i05_list_declarations_shallow(t):
    d = S.decls(t)
    return search.shallow(d, search.list_declarations(d, "m0/n0/c300.rs")).select("decl_ord", "kind", "name", "line", "children")


@_query(f"""select path, source, line, text from (select path, 'import' as source, null::int as line, text, import_ord as o from {IM} i where regexp_matches(text, '(^|[^A-Za-z0-9_])c77($|[^A-Za-z0-9_])')
union all select path, 'signature', line::int, signature, decl_ord from {D} d where regexp_matches(signature, '(^|[^A-Za-z0-9_])c77($|[^A-Za-z0-9_])') and name <> 'c77') order by {_P}, source, o limit 20""")
def i06_callers(t):
    return search.callers(S.decls(t), S.imports(t), "c77").withColumn("line", F.col("line").cast("int"))


@_query(f"""select path, name, line, case when path = 'm1/n1/c301.py' then 'same_file' when contains(string_split(path, '/')[-1], 'test') then 'test_file' else 'name_convention' end as reason from {D} d
where is_test and contains(lower(name), 'part1') order by case when path = 'm1/n1/c301.py' then 0 else 1 end, {_P}, decl_ord limit 20""")
def i07_related_tests(t):
    return search.related_tests(S.decls(t), "part1", "m1/n1/c301.py")


@_query(f"select member, path from {FI} f where path = 'c7_test.go' or ends_with(path, '/c7_test.go') order by member, {_P} limit 1")
def i08_find_file(t):
    return search.find_file(S.files(t), "c7_test.go").select("member", "path")


@_query(f"select path, count(*)::bigint as declarations, count(*) filter (visibility = 'Public')::bigint as public, bool_or(is_test) as has_tests, count(*) filter (kind = 'Method')::bigint as methods from {D} d group by 1")
def i09_file_summaries(t):
    return search.file_summaries(S.decls(t)).select("path", "declarations", "public", "has_tests", F.coalesce(F.col("kinds")["Method"], F.lit(0)).alias("methods"))


@_query(f"select path, lines, (select count(*) from {D} d where d.path = f.path)::bigint as declarations from {FI} f where regexp_matches(path, '^(.*/)?c1[0-4][^/]*\\.(rs|py)$') order by {_P} limit 30")
def i10_batch_summaries(t):
    return search.batch_summaries(S.decls(t), S.files(t), glob="c1[0-4]*.{rs,py}")[0].select("path", "lines", "declarations")


@_query(f"select path as file, arg_min(text, import_ord) as import from {IM} i where path <> 'm2/n2/c77.py' and (contains(text, 'c77') or contains(text, 'm2/n2/c77')) group by 1")
def i11_imported_by(t):
    return search.imported_by(S.imports(t), "m2/n2/c77.py")


@_query(f"""with f as {FI} select path as file, 'test' as relation from f where path <> 'm0/n3/c3.rs' and starts_with(string_split(path, '/')[-1], 'c3_test.')
union all select * from (select path, 'sibling' from f where path <> 'm0/n3/c3.rs' and not starts_with(string_split(path, '/')[-1], 'c3_test.') and starts_with(path, 'm0/n3/') order by {_P} limit 10)""")
def i12_related_files(t):
    return search.related_files(S.files(t), "m0/n3/c3.rs")


@_query(f"select path, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) as source from {CO} c")
def i13_read_lines(t):
    return search.read_lines(S.contents(t), 2, 4).select("path", "source")


@_query(f"""with d as {D}, hit as (select path, case lower(name) when 'order42' then 0 else 1 end as ord, min(decl_ord) as decl_ord from d where lower(name) in ('order42', 'get_part9') group by 1, 2),
h as (select hit.path, ord, name, line, least(coalesce(body_lines, 0) + 1, 200) as n from hit join d on d.path = hit.path and d.decl_ord = hit.decl_ord),
w as (select *, 500 - coalesce(sum(n) over (partition by path order by ord rows between unbounded preceding and 1 preceding), 0) as rest from h)
select w.path, ord, name, line, array_to_string(list_slice(string_split(text, chr(10)), line, line + least(n, rest) - 1), chr(10)) as source from w join {CO} c on c.path = w.path where rest > 0""")
def i14_read_symbols(t):
    return search.read_symbols(S.contents(t), S.decls(t), ["Order42", "get_part9"]).select("path", "ord", "name", "line", "source")


@_query(f"""select path, regexp_replace(text, '\\{{ \\{{ x \\}} \\}}', '{{ ... }}', 'g') as collapsed from (select path, string_agg(signature || ' {{ {{ x }} }}', chr(10) order by decl_ord) as text from {D} d where depth > 0 group by 1)""")
def i15_collapse_bodies(t):
    from ..functions.collapse import collapsed
    from ..session import ship

    d = S.decls(t)
    ship(d.sparkSession)
    one = d.where("depth > 0").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decl_ord", F.concat(F.lit("{"), "signature", F.lit(" { { x } }}")).alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    # each line in braces of its own: the bodies in them are the nested ones
    return one.select("path", F.regexp_replace(F.regexp_replace(collapsed(F.col("text")), r"(?m)^\{", ""), r"(?m)\}$", "").alias("collapsed"))


@_query(f"select count(*)::bigint as files, coalesce(sum(ceil(size / 4.0::double)), 0)::bigint as tokens, coalesce(sum(lines), 0)::bigint as lines from {FI} f where starts_with(path, 'm1/n1') and regexp_matches(path, '^(.*/)?[^/]*\\.rs$')")
def i16_token_estimates(t):
    return search.token_estimates(S.files(t), "m1/n1", "*.rs")[0]


@_query(f"select path, ceil(size / 4.0::double)::bigint as tokens from {FI} f order by tokens desc, {_P} limit 50")
def i17_token_breakdown(t):
    return search.token_estimates(S.files(t))[1].select("path", "tokens")


@_query(f"select member, count(*)::bigint as files, sum(lines)::bigint as lines, (select count(*) from {D} d where d.member = f.member)::bigint as declarations from {FI} f group by 1")
def i18_members(t):
    return search.members(S.files(t), S.decls(t))


@_query(f"""with d as {D} select path, decl_ord from d where exists (select 1 from d m where m.path = d.path and m.decl_ord between d.decl_ord and d.subtree_end and m.kind = 'Trait')
or exists (select 1 from d m where m.path = d.path and m.decl_ord between d.decl_ord and d.subtree_end and m.kind = 'Field' )""")
def i20_kind_filter(t):
    return trees.by_kind(S.decls(t), ["Trait", "Field"]).select("path", "decl_ord")


@_query(f"with d as {D} select path, decl_ord from d where not exists (select 1 from d m where m.path = d.path and m.visibility = 'Private' and d.decl_ord between m.decl_ord and m.subtree_end)")
def i21_public_filter(t):
    return trees.public_only(S.decls(t)).select("path", "decl_ord")


@_query(f"""with d as {D}, m as (select * from d where contains(lower(name), 'part7')) select path, decl_ord from d where exists (select 1 from m where m.path = d.path and (m.decl_ord between d.decl_ord and d.subtree_end or d.decl_ord between m.decl_ord and m.subtree_end))""")
def i22_symbol_filter(t):
    return trees.by_symbol(S.decls(t), "Part7").select("path", "decl_ord")


@_query(f"""with d as {D}, f as {FI}, a as (select * from d where starts_with(path, 'm1/')), k as (select * from a where exists (select 1 from a m where m.path = a.path and m.decl_ord between a.decl_ord and a.subtree_end and m.kind = 'Method')),
p as (select * from k where not exists (select 1 from k m where m.path = k.path and m.visibility = 'Private' and k.decl_ord between m.decl_ord and m.subtree_end))
select coalesce(member, '*') as member, coalesce(language, '*') as language, count(*)::bigint as files, coalesce(sum(lines), 0)::bigint as lines from f where path in (select path from p) group by rollup (member, language)""")
def i23_filters_and_stats(t):
    f, _, _ = trees.filter_index(S.files(t), S.decls(t), S.imports(t), "m1", ["Method"], public=True)
    return trees.stats(f).select(F.coalesce("member", F.lit("*")).alias("member"), F.coalesce("language", F.lit("*")).alias("language"), "files", "lines")


@_query(f"""with f as {FI}, t as (select path, false as is_dir from f union select distinct array_to_string(list_slice(string_split(path, '/'), 1, i), '/'), true from f, unnest(range(1, len(string_split(path, '/')))) u(i))
select path, string_split(path, '/')[-1] as name, is_dir, len(string_split(path, '/'))::int as depth from t where starts_with(path, 'm1/n1/') or path = 'm1/n1' or path = 'm1'""")
def i24_tree(t):
    return trees.tree(S.files(t), "m1/n1").select("path", "name", "is_dir", "depth")


@_query(f"select path, row_number() over (order by {_P})::bigint as file_ord from {FI} f")
def i25_component_order(t):
    return order.numbered(S.files(t).select("path"), [F.split("path", "/")], "file_ord")


_TOK = "(3 + ceil(strlen(signature) / 4.0::double) + case when doc_comment is null then 0 else 2 + ceil(strlen(doc_comment) / 4.0::double) end + 5 + coalesce(list_sum(list_transform(relationships, lambda r: 3 + ceil(strlen(regexp_replace(r, '^[^ ]* ', '')) / 4.0::double))), 0))::bigint"
FILE_TOKENS = f"(select f.path, (15 + ceil(strlen(f.path) / 4.0::double) + coalesce(dt, 0) + coalesce(it, 0))::bigint as tokens from {FI} f left join (select path, sum({_TOK}) as dt from {D} d group by 1) d on d.path = f.path left join (select path, sum(3 + ceil(strlen(text) / 4.0::double)) as it from {IM} i group by 1) i on i.path = f.path)"


@_query(f"select path, tokens from {FILE_TOKENS} x")
def i26_file_tokens(t):
    return budget.file_tokens(S.files(t), S.decls(t), S.imports(t)).select("path", "tokens")


IMPORTANCE = f"(select f.path, (case when ends_with(f.path, '/main.rs') then 100 else 0 end - 5 * (len(string_split(f.path, '/')) - 1) + 3 * coalesce(n, 0) - lines // 100)::bigint as importance from {FI} f left join (select path, count(*) as n from {D} d where visibility = 'Public' group by 1) p on p.path = f.path)"


@_query(f"select path, importance from {IMPORTANCE} x")
def i27_importance(t):
    return budget.importance(S.files(t), S.decls(t)).select("path", "importance")


@_query(f"""with f as (select path, tokens, importance, member from {FILE_TOKENS} a join {IMPORTANCE} b using (path) join {FI} c using (path)),
s as (select path, coalesce(sum(tokens) over (order by importance, {_P}, member rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (order by importance desc, {_P} desc, member desc) as back from f)
select path from s where before >= 20000 or back = 1""")
def i28_drop_least_important(t):
    return budget.without_least(S.files(t), S.decls(t), S.imports(t), 20000).select("path")


@_query(f"""with d as {D} select path, decl_ord, cast(null as varchar) as doc_comment from d where depth = 0 and visibility <> 'Private'""")
def i29_budget_stages(t):
    ix = budget.Index("root", S.files(t), S.decls(t), S.imports(t), trees.tree_entries(S.files(t)))
    for stage in (budget.shortened, budget.undocumented, budget.without_private, budget.flat):
        ix = stage(ix)
    return ix.decls.select("path", "decl_ord", "doc_comment")


@_query(f"select path, decl_ord, case when strlen(doc_comment) > 80 then regexp_replace(substring(split_part(doc_comment, chr(10), 1), 1, 80), '\\.+$', '') || '...' else doc_comment end as doc_comment from {D} d where depth = 0")
def i30_budget_fits(t):
    """The whole budget, with a limit that the first stage meets: the comments shortened, all else as it was. The index is
    written once, as it is read for each estimate."""
    decls = saved(S.decls(t).select("member", "path", "language", "decl_ord", "subtree_end", "depth", "visibility", "signature", "line", "doc_comment", "relationships"))
    files = saved(S.files_of(decls))
    ix = budget.Index("root", files, decls, S.imports(t), trees.tree_entries(files))
    first = budget.index_tokens(budget.shortened(ix))
    fitted, stage = budget.fitted(ix, first)
    if stage != 1:
        raise AssertionError(stage)
    return fitted.decls.where("depth = 0").select("path", "decl_ord", "doc_comment")


_RESOLVED = f"""(with f as {FI}, i as {IM}, c as (select path, import_ord, lower(regexp_extract(text, 'crate::(.*)::Thing', 1)) as raw from i),
k as (select path, import_ord, replace(raw, '::', '/') as cand from c), u as (select distinct cand from k),
m as (select cand, arg_min(path, [strlen(path)::varchar, path]) as target from u join (select path, lower(path) as low, lower(regexp_replace(path, '\\.[^./]*$', '')) as stem from f) p on ends_with(low, cand) or ends_with(stem, cand) group by 1)
select k.path, k.import_ord, m.target from k join m using (cand) where m.target <> k.path)"""


@_query(f"select path, import_ord, target from {_RESOLVED} r")
def i31_resolve_imports(t):
    return graph.resolve_imports(S.imports(t), S.files(t))


@_query(f"select distinct path as src, target as dst, 'Imports' as kind from {_RESOLVED} r")
def i32_file_graph(t):
    return graph.file_graph(S.imports(t), S.files(t))


@_query(f"""with recursive e as (select distinct path as src, target as dst from {_RESOLVED} r), r(node, d) as (select path, 0 from {FI} f where contains(lower(path), 'n7/') union select e.dst, r.d + 1 from r join e on e.src = r.node where r.d < 1)
select src, dst, 'Imports' as kind from e where src in (select node from r) and dst in (select node from r)""")
def i33_scoped_file_graph(t):
    return graph.file_graph(S.imports(t), S.files(t), scope="N7/", depth=1)


SYMBOLS = f"(select *, path || '::' || name || case when k > 1 then '#' || k else '' end as symbol_id from (select *, row_number() over (partition by path, name order by decl_ord) as k from {D} d) x)"


@_query(f"select symbol_id, decl_ord from {SYMBOLS} s")
def i34_symbol_ids(t):
    return graph.symbol_ids(S.decls(t), "path", "name", ["decl_ord"]).select("symbol_id", "decl_ord")


_REL = f"select distinct a.symbol_id as src, b.symbol_id as dst, 'Implements' as kind from (select symbol_id, unnest(relationships) as r from s) a join s b on b.name = substring(a.r, strlen('implements ') + 1) where a.symbol_id <> b.symbol_id"


@_query(f"with s as {SYMBOLS} {_REL}")
def i35_relationship_edges(t):
    return graph.relationship_edges(graph.symbol_ids(S.decls(t), "path", "name", ["decl_ord"]))


@_query(f"""with s as {SYMBOLS}, w as (select distinct symbol_id, unnest(regexp_split_to_array(signature, '[^A-Za-z0-9_]+')) as name from s),
ty as (select symbol_id, name from s where contains(signature, 'struct ') or contains(signature, 'trait '))
select distinct w.symbol_id as src, ty.symbol_id as dst, 'References' as kind from w join ty using (name) where w.symbol_id <> ty.symbol_id""")
def i36_reference_edges(t):
    return graph.reference_edges(graph.symbol_ids(S.decls(t), "path", "name", ["decl_ord"]))


@_query(f"""with e as (select distinct path as src, target as dst from {_RESOLVED} r) select id, string_split(id, '/')[-1] as label from (select src as id from e union select dst from e)""")
def i37_graph_nodes(t):
    return graph.nodes_of(graph.file_graph(S.imports(t), S.files(t)))


@_query(f"""select type, role, count(*)::bigint as uses from (select 'Order' || regexp_extract(signature, 'a: Order([0-9]+)', 1) as type, 'consumer' as role from {D} d where kind = 'Method' and language in ('Rust', 'TypeScript', 'Python')
union all select 'Order' || regexp_extract(signature, '-> Order([0-9]+)', 1), 'producer' from {D} d where kind = 'Method' and language in ('Rust', 'Python')) group by 1, 2""")
def i38_type_flows(t):
    d = S.decls(t).where(F.col("language").isin("Rust", "TypeScript", "Python"))
    return types.flows(d).groupBy("type", "role").agg(F.count("*").alias("uses"))


@_query(f"""with d as {D} select * from (select 'producer' as role, path, kind, name, signature from d where kind = 'Method' and language = 'Rust' and ends_with(signature, '-> Order42') order by {_P}, decl_ord limit 50)
union all select * from (select 'consumer', path, kind, name, signature from d where language = 'Rust' and ((kind = 'Method' and contains(signature, 'a: Order42,')) or (kind = 'Field' and ends_with(signature, ': Order42'))) order by {_P}, decl_ord limit 50)""")
def i39_type_flow(t):
    return types.type_flow(S.decls(t).where("language = 'Rust'"), "order42", fields=True).drop("line")


@_query(f"""select count(*)::bigint as functions, count(*) filter (is_test)::bigint as tests, count(*) filter (is_deprecated)::bigint as deprecated, count(*) filter (visibility = 'Public')::bigint as public, count(doc_comment)::bigint as documented
from {D} d where kind in ('Function', 'Method')""")
def i40_declaration_counts(t):
    return health.declaration_counts(S.decls(t))


@_query(f"""with o as (select path, kind, name, arg_max(signature, decl_ord) as sig from {D} d where depth <= 1 and decl_ord > 3 group by 1, 2, 3), n as (select path, kind, name, arg_max(signature, decl_ord) as sig from (select *exclude(signature), case when line % 5 = 0 then signature || '!' else signature end as signature from {D} d) where depth <= 1 and decl_ord < 40 group by 1, 2, 3),
was as (select distinct path from {D} d where decl_ord > 3), now as (select distinct path from {D} d where decl_ord < 40)
select path, case when was.path is null then 'added' when now.path is null then 'removed' else 'modified' end as file_change, kind, name, case when o.sig is null then 'added' when n.sig is null then 'removed' else 'modified' end as change, o.sig as old_value, n.sig as new_value
from o full join n using (path, kind, name) left join was using (path) left join now using (path) where o.sig is distinct from n.sig""")
def i41_declaration_diff(t):
    d = S.decls(t)
    new = d.where("decl_ord < 40").withColumn("signature", F.when(F.col("line") % 5 == 0, F.concat("signature", F.lit("!"))).otherwise(F.col("signature")))
    return difference.declaration_diff(d.where("decl_ord > 3"), new)


@_query("select doc_id, n_chars, lang from (select *, row_number() over (partition by n_chars, lang order by doc_id) as k from documents) where k = 1")
def i42_first_wins(t):
    return difference.first_wins(t("documents").select("doc_id", "n_chars", "lang"), ["n_chars", "lang"], ["doc_id"])


@_query(f"""select case when string_split(path, '/')[1] = 'm1' then 'm1/' || string_split(path, '/')[2] else string_split(path, '/')[1] end as grp, count(*)::bigint as files, sum(lines)::bigint as lines, sum(size)::bigint as bytes from {FI} f group by 1""")
def i43_preflight_groups(t):
    return preflight.groups(S.files(t), preflight.group_key(F.col("path"), deep=("m1",)))


@_query(f"""select f.path, lines, count(d.path)::bigint as declarations, size from {FI} f left join {D} d on d.path = f.path group by 1, 2, 4 order by lines desc, declarations desc, size desc, string_split(f.path, '/') limit 20""")
def i44_largest_files(t):
    return preflight.largest_files(S.files(t), S.decls(t))


@_query(f"""with x as (select path, case when list_contains(string_split(path, '/'), 'n7') then 'n7' when list_contains(string_split(path, '/'), 'm1') then 'm1' end as flag from {FI} f)
select flag, count(*)::bigint as files, array_to_string(list_slice(list(path order by {_P}), 1, 3), ' ') as examples from x where flag is not null group by 1""")
def i45_suspicious(t):
    return preflight.suspicious(S.files(t), ("n7", "m1")).select("flag", "files", F.array_join("examples", " ").alias("examples"))


MEMBERS = "(select * from (values ('a', 'm1'), ('b', 'm1/n1'), ('c', 'm2/n2/c77.py'), ('d', '')) v(owner, root))"


@_query(f"select path, arg_max(owner, length(root)) as member from {FI} f join {MEMBERS} m on root = '' or path = root or starts_with(path, root || '/') group by 1")
def i46_owning_member(t):
    f = S.files(t).select("path")
    m = f.sparkSession.createDataFrame([("a", "m1"), ("b", "m1/n1"), ("c", "m2/n2/c77.py"), ("d", "")], "member string, root string")
    return preflight.owning_member(f, m).select("path", "member")


@_query(f"""select path, decl_ord, '[' || to_json(name) || ',' || line || ',' || coalesce(to_json(doc_comment), 'null') || ',null]' as compact from {D} d""")
def i47_compact(t):
    return search.compact(S.decls(t), ["name", "line", "doc_comment", "nothing"]).select("path", "decl_ord", "compact")


@_query(f"""with s as (select path, 3 * (case when contains(lower(name), 'order42') then 10 else 0 end + case when lower(name) = 'order42' then 20 else 0 end + case when contains(lower(name), 'order42') then 5 else 0 end + case when lower(name) = 'order42' then 3 else 0 end) as x, decl_ord from {D} d)
select count(*)::bigint as n from s where x > 90""")
def i48_exact_names_score_most(t):
    d = S.decls(t)
    return d.where(3 * X.score_match(F.lower("name"), "order42") > 90).agg(F.count("*").alias("n"))
