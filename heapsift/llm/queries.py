"""The queries of this subpackage, by name, over the tables of a folder; and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontaminate, licenses, lines, neighbours, quality, simhash, substrings, toxicity, warc
from .common import table


def op1_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lines(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_licenses(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_neighbours(spark, sf_dir):
    return neighbours.report(table(spark, sf_dir, "embeddings"))


def op7_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substrings(spark, sf_dir):
    return substrings.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontaminate, op3_lines, op4_bpe, op5_licenses, op6_neighbours, op7_quality, op8_substrings, op9_simhash, op10_toxicity)}

_WORDS = r"coalesce(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_TEMPLATES = ", ".join(f"({i}, '{label}', {phrase}, '{text}')" for i, (label, phrase, text) in enumerate([(x, "true", p) for p, x in licenses.PHRASES.items()] + [(x, "false", t) for x, t in licenses.TEMPLATES]))

ORACLES = {
    "op5_licenses": f"""
with d as (select doc_id, {_WORDS.format("text")} w from documents),
t as (select tid, label, phrase, {_WORDS.format("body")} w from (values {_TEMPLATES}) v(tid, label, phrase, body)),
g as (select tid, label, phrase, p - 1 as place, case when phrase then len(w) else {licenses.K} end k, case when phrase then 1 else len(w) - {licenses.K - 1} end total,
 array_to_string(case when phrase then w else w[p:p + {licenses.K - 1}] end, ' ') gram from t, unnest(range(1, case when phrase then 2 else len(w) - {licenses.K - 2} end)) u(p)),
x as (select doc_id, k, p - 1 as pos, array_to_string(w[p:p + k - 1], ' ') gram from d, (select distinct k from g), unnest(range(1, len(w) - k + 2)) u(p)),
hit as (select doc_id, tid, label, phrase, total, pos, place, pos - place diagonal from x join g using (k, gram)),
v as (select distinct doc_id, tid, phrase, diagonal from hit),
f as (select *, case when phrase or diagonal - lag(diagonal) over (partition by doc_id, tid order by diagonal) <= {licenses.GAP} is not true then 1 else 0 end fresh from v),
sp as (select doc_id, tid, diagonal, sum(fresh) over (partition by doc_id, tid order by diagonal) span from f),
m as (select doc_id, tid, span, any_value(label) label, any_value(phrase) phrase, min(pos) lo, count(distinct place) / any_value(total) share from hit join sp using (doc_id, tid, diagonal) group by all),
b as (select doc_id, count(*) filter (phrase) n_base, min(lo) filter (phrase) first_word, max(lo) filter (phrase) last_word, string_agg(distinct label, ',' order by label) filter (phrase) base_labels,
 string_agg(distinct label, ',' order by label) filter (phrase or share >= {licenses.SHARE}) labels, max(least(share, 1.0)) filter (phrase or share >= {licenses.SHARE}) score from m group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score
from d left join b using (doc_id)""",
    "op8_substrings": r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
x as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) g from d, unnest(range(1, len(w) - 48)) u(p)),
m as (select g, min(doc_id) least_id from x group by g),
c as (select distinct doc_id, q from x join m using (g), unnest(range(p, p + 50)) u(q) where doc_id > least_id),
k as (select doc_id, p, w[p] word from d, unnest(range(1, len(w) + 1)) u(p)),
s as (select k.doc_id, string_agg(word, ' ' order by p) kept, count(*) n from k left join c on c.doc_id = k.doc_id and c.q = k.p where c.q is null group by k.doc_id)
select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join s using (doc_id)""",
    "op1_warc": warc.ORACLE,
    "op2_decontaminate": f"""
with d as (select doc_id, {_WORDS.format("text")} w from documents),
i as (select item_id, {_WORDS.format("text")} w from benchmark),
iw as (select distinct item_id, least(10, len(w)) k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') g from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(p) where len(w) > 0),
ks as (select distinct k from iw),
dw as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') g from d, ks, unnest(range(1, len(w) - k + 2)) u(p)),
hit as (select doc_id, p, iw.k, item_id from dw join iw on dw.k = iw.k and dw.g = iw.g),
pos as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + k)) q from hit) group by doc_id),
ids as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join ids using (doc_id)""",
}
