"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import bm25, collocations, decontaminate, html_text, licenses, line_rules, odd_sketch, packing, prefix_tokens, quality, surrogates, token_links, toxicity


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.graded(docs, quality.model(docs, table(spark, sf, "labels")))


def op2_bm25_wand(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.similar_to_whole_documents(table(spark, sf, "documents"))


def op3_prefix_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_tokens.token_budget(table(spark, sf, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op5_toxicity_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.scored(docs, toxicity.model(docs, table(spark, sf, "labels")))


def op6_html_text_density(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extracted(table(spark, sf, "pages"))


def op7_license_templates(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf, "documents"))


def op8_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return surrogates.replaced(table(spark, sf, "documents").select("doc_id", "text"), count="n_entities")


def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_minhash_odd_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf, "documents"))


def op11_token_links(spark: SparkSession, sf: str) -> DataFrame:
    return token_links.link_report(table(spark, sf, "documents"))


def op12_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules.line_report(table(spark, sf, "documents"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


WORD = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
       r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    n = decontaminate.WINDOW
    size = odd_sketch.SHINGLE
    r = line_rules
    quoted = lambda text: text.replace("'", "''")
    c = collocations
    return {
        "op13_collocations": rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
totals as (select lang, sum(len(w))::bigint as n from w group by lang),
f as (select lang, size, array_to_string(w[k:k + size - 1], ' ') as phrase, count(*) as f
      from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as k from w, range(1, {c.LONGEST + 1}) t(size))
      group by all having count(*) >= {c.LEAST}),
cand as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size > 1),
inside as (select distinct g.lang, g.phrase from (
             select lang, size, f, part, unnest(range(1, size - part + 2)) as k, string_split(phrase, ' ') as w, array_to_string(w[k:k + part - 1], ' ') as within
             from (select *, unnest(range(2, size)) as part from f where size > 2)) x
           join f g on g.lang = x.lang and g.phrase = x.within where 100 * x.f >= {c.KEPT} * g.f),
cuts as (select c.lang, c.phrase, a, k, x.f as l, y.f as r, {c.SCALE}::hugeint * a // (x.f + y.f) as score
         from (select *, unnest(range(1, size)) as k, array_to_string(w[:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail from cand) c
         join f x on x.lang = c.lang and x.phrase = head join f y on y.lang = c.lang and y.phrase = tail),
best as (select lang, phrase, a, l, r, score::bigint as score from cuts
         qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
           from best where (lang, phrase) not in (select lang, phrase from inside))
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {c.TOP}""",
        "op12_line_rules": rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
places as (select doc_id, k, array_to_string(w[k:k + {r.WINDOW - 1}], ' ') as line
           from (select doc_id, w, unnest(range(1, len(w) - {r.WINDOW - 2})) as k from w)),
again as (select doc_id, unnest(range(k, k + {r.WINDOW})) as p
          from (select doc_id, k, count(*) over (partition by doc_id, line) as n from places) where n > 1),
repeats as (select doc_id, count(distinct p) as n_repeat_words from again group by doc_id),
lines as (select doc_id, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
                 regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w
          from (select doc_id, unnest(string_split(t, chr(10))) as line from d)),
seen as (select doc_id, line, len(w) as n,
                len(regexp_extract_all(line, '[{r.SEPARATORS}]')) as separators,
                len(w) <= {r.SHORT} and (regexp_full_match(low, '{r.MENU}') or regexp_matches(low, '{r.BOILERPLATE}')) as repeated,
                not regexp_matches(line, '[{r.ENDS}][{quoted(r.CLOSERS).replace("]", "")}\]]*[\x20\x09-\x0D]*$') as unfinished,
                len(list_filter(w, lambda x: regexp_matches(x, '{r.MARKS.decode()}'))) as noisy
         from lines where len(w) > 0),
judged as (select doc_id, count(*) - count(distinct line) as n_dup_lines, count(*) filter (bad) as n_failed_lines,
                  coalesce(sum(n) filter (bad), 0) as n_lost_words
           from (select *, (separators > 1 and 3 * separators >= n) or repeated or unfinished or 100 * noisy > {r.NOISE} * n as bad
                 from seen) group by doc_id),
counted as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
                   coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_failed_lines, 0) as n_failed_lines,
                   coalesce(n_lost_words, 0)::bigint as n_lost_words
            from w left join repeats using (doc_id) left join judged using (doc_id))
select *, n_words < {r.LEAST_WORDS} or 100 * n_repeat_words > {r.REPEATED} * n_words as base_failed,
       not base_failed and 100 * n_lost_words <= {r.LOST} * n_words as kept from counted""",
        "op10_minhash_odd_sketch": rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + {size - 1}], ' ') as line
      from (select doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) as k from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.line = b.line and a.doc_id <> b.doc_id group by all),
e as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
      where {odd_sketch.OF} * c >= {odd_sketch.SIMILAR} * (x.n + y.n - c)),
r as (select doc_id, doc_id as c from d union select r.doc_id, e.b from r join e on r.c = e.a)
select d.doc_id, coalesce(n, 0) as n_shingles, min(c) as component_id, d.doc_id = min(c) as kept
from d left join n using (doc_id) join r on r.doc_id = d.doc_id group by d.doc_id, n""",
        "op9_decontaminate": f"""
with d as (select doc_id, {WORD} as w from documents),
b as (select item_id, {WORD} as w from benchmark),
bw as (select distinct item_id, array_to_string(w[k:k + {n - 1}], ' ') as line, least(len(w), {n}) as n
       from (select item_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) as k from b where len(w) > 0)),
sizes as (select distinct n from bw),
places as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n),
found as (select doc_id, k, p.n, item_id from places p join bw on bw.n = p.n and bw.line = array_to_string(w[k:k + p.n - 1], ' ')),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
          from (select distinct doc_id, item_id::varchar as id from found) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and {decontaminate.SHARE} * n_hit >= len(w), false) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)""",
    }
