"""The wiki's operators on pages made of documents, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wiki
from . import standins as S
from .index_queries import _query

P, FI, D = S.PAGES, S.FILES, S.DECLS
_Q = "the n7"


def _pick(text: str, whole: int, part: int) -> str:
    return f"case when contains({text}, '{_Q}') then {whole} when contains({text}, 'the') or contains({text}, 'n7') then {part} else 0 end"


_SCORE = f"""(case when lower(title) = '{_Q}' then 100 else {_pick('lower(title)', 50, 25)} end + {_pick('lower(id)', 40, 15)} + list_sum(list_transform(covers, lambda c: {_pick('lower(c)', 30, 10)}))
 + case when contains(lower(content), '{_Q}') then 20 else case when contains(lower(content), 'the') then 5 else 0 end + case when contains(lower(content), 'n7') then 5 else 0 end end
 + case when len(list_filter(source_files, lambda f: contains(lower(f), 'the') or contains(lower(f), 'n7'))) > 0 then 10 else 0 end + coalesce({_pick('lower(symptom)', 25, 8)}, 0))::bigint"""


@_query(f"select page_ord, id, score, open_contradictions::int as unresolved_contradictions, open_failures::int as unresolved_failures from (select *, {_SCORE} as score from {P} p) x where score > 0 order by score desc, page_ord limit 50")
def w01_wiki_search(t):
    return wiki.search(S.pages(t), _Q, 50).select("page_ord", "id", "score", F.col("unresolved_contradictions").cast("int"), F.col("unresolved_failures").cast("int"))


@_query(f"select id, {_SCORE} as score from {P} p")
def w02_wiki_scores(t):
    return S.pages(t).select("id", wiki.search_score(_Q).alias("score"))


@_query(f"select id from {P} p where lower(id) = 'p77' or lower(title) = 'p77' or contains(lower(id), 'p77') or contains(lower(title), 'p77') order by case when id = 'P77' then 0 when lower(id) = 'p77' or lower(title) = 'p77' then 1 else 2 end, page_ord limit 1")
def w03_wiki_read(t):
    return wiki.read(S.pages(t), "P77").select("id")


_WORDS = ["with", "that", "that", "from"]
_ADD = lambda text, n: " + ".join(f"case when contains({text}, '{w}') then {n * _WORDS.count(w)} else 0 end" for w in dict.fromkeys(_WORDS))


@_query(rf"""select id, (case when list_contains(source_files, 'm1/n7/c7_test.go') then 50 else 0 end + {_ADD('lower(title)', 10)} + {_ADD("lower(substring(regexp_replace(content, '^[ ]*#[^' || chr(10) || ']*' || chr(10), ''), 1, 1000))", 2)})::bigint as score from {P} p where page_type <> 'index'""")
def w04_contribution_scores(t):
    return S.pages(t).where("page_type <> 'index'").select("id", wiki.contribution_score("With that of", "that is from", ["m1/n7/c7_test.go"]).alias("score"))


@_query(f"""select count(*)::bigint as files, count(c)::bigint as covered, (count(*) - count(c))::bigint as uncovered, printf('%.0f%%', 100.0::double * count(c) / count(*)) as percent
from {FI} f left join (select distinct unnest(source_files) as path, 1 as c from {P} p) s using (path)""")
def w05_wiki_coverage(t):
    return wiki.coverage(S.files(t), S.pages(t))


@_query(f"select path from {FI} f where path not in (select unnest(source_files) from {P} p)")
def w06_uncovered(t):
    return wiki.uncovered(S.files(t), S.pages(t)).select("path")


@_query(f"select id from {P} p where page_type <> 'index' and len(list_filter(source_files, lambda f: starts_with(f, 'm1/n7/'))) > 0")
def w07_affected_pages(t):
    return wiki.affected(S.pages(t), S.files(t).where("startswith(path, 'm1/n7/')")).select("id")


@_query(f"select count(*)::bigint as pages, sum(contradictions)::bigint as contradictions, sum(open_contradictions)::bigint as open_contradictions, sum(failures)::bigint as failures, sum(open_failures)::bigint as open_failures from {P} p")
def w08_wiki_status(t):
    return wiki.status(S.pages(t))


@_query(f"select page_type, count(*)::bigint as pages from {P} p group by 1")
def w09_pages_by_type(t):
    return wiki.by_type(S.pages(t))


@_query(f"select path, string_agg('struct:' || name, ' ' order by decl_ord) as covers from {D} d where visibility = 'Public' and depth = 0 and starts_with(path, 'm1/') group by 1")
def w10_public_covers(t):
    return wiki.public_covers(S.decls(t), S.files(t).where("startswith(path, 'm1/')")).select("path", F.array_join("covers", " ").alias("covers"))


@_query(f"""with c as (select path, string_agg('struct:' || name, ', ' order by decl_ord) as covers from {D} d where visibility = 'Public' and depth = 0 group by 1),
s as (select path, '- ' || path || ' (' || language || ', ' || lines || ' lines): ' || coalesce(covers, '') as summary from {FI} f left join c using (path)),
r as (select *, sum(strlen(summary) + 1) over (order by string_split(path, '/')) as upto from s) select path, summary from r where upto <= 100000""")
def w11_planning_context(t):
    return wiki.planning_context(S.files(t), S.decls(t))


@_query(f"""with u as (select *, regexp_replace(path, '/[^/]*$', '') as folder from {FI} f where path not in (select unnest(source_files) from {P} p where page_ord < 400)),
g as (select folder, count(*)::bigint as files, sum(lines)::bigint as lines from u group by 1), s as (select distinct regexp_replace(path, '/[^/]*$', '') as folder, id, path from (select id, unnest(source_files) as path from {P} p where page_ord < 400) x),
n as (select folder, id, count(*) as n from s group by 1, 2), b as (select folder, id from (select *, row_number() over (partition by folder order by n desc, id desc) as k from n) x where k = 1)
select folder, files, lines, coalesce(id, case when files >= 3 or lines >= 500 then 'module' else 'architecture' end) as target from g left join b using (folder)""")
def w12_coverage_repair(t):
    return wiki.repair_groups(S.files(t), S.pages(t).where("page_ord < 400"))


@_query(f"select id, case when id = 'p7' then 'new text' else content end as content, page_ord from {P} p union all select 'fresh', 'fresh text', (select max(page_ord) + 1 from {P} p)")
def w13_wiki_upsert(t):
    p = S.pages(t).select("id", "content", "page_ord")
    return wiki.upsert(p, p.sparkSession.createDataFrame([("p7", "new text", None), ("fresh", "fresh text", None)], p.schema)).select("id", "content", "page_ord")


@_query("""with c as (select doc_id, '[[A' || doc_id % 9 || ']] and [[b|x]]' || chr(10) || '```' || chr(10) || '[[c]]' || chr(10) || '```' || chr(10) || '[[b]] ' || source as content from documents)
select doc_id, 'a' || doc_id % 9 || ',b' as links from c""")
def w14_page_links(t):
    content = F.expr("concat('[[A', doc_id % 9, ']] and [[b|x]]\n```\n[[c]]\n```\n[[b]] ', source)")
    return t("documents").select("doc_id", F.array_join(wiki.links(content), ",").alias("links"))
