"""SQL that gives the same rows as a query, for those that SQL can express.

The searches by an approximate index (p1, p3) are tested against brute force instead.
"""

from __future__ import annotations

from chainloom.llm.lookalike import _table


def _letters(c: str) -> str:
    return f"regexp_replace(upper(coalesce({c},'')), '[^\\p{{L}}]', '', 'g')"


_CODE = "upper(regexp_extract(id, '(\\p{L}+)', 1))"
_NUMBER = "regexp_extract(id, '([0-9]+)', 1)"

P2_FOUND = f"""with recursive r as (select distinct id, {_letters('heavy')} h, {_letters('light')} l from dev where id is not null),
k as (select distinct id, 'i' || {_CODE} || '|' || ltrim({_NUMBER}, '0') k from r where {_CODE} <> '' and {_NUMBER} <> '' union select id, 'h' || h from r where h <> '' union select id, 'l' || l from r where l <> ''),
e as (select distinct a.id a, b.id b from k a join k b on a.k = b.k where a.id <> b.id),
c as (select a node, b reach from e union select c.node, e.b from c join e on e.a = c.reach)
select node id_a, reach id_b from c where node < reach"""

# Pairs at 0.94 share a stretch of 12 letters of their rings, for n - 12 d > 0; shorter texts are equal.
_RECORDS = f"""r as (select distinct id, least(h,l) x, greatest(h,l) y from (select id, {_letters('heavy')} h, {_letters('light')} l from dev where id is not null) where h <> '' or l <> ''),
t as (select x, y, row_number() over (order by x, y) k from (select distinct x, y from r)),
g as (select distinct k, substring(s, i, 12) g from (select k, x||y||left(repeat(x||y, 11), 11) s, unnest(range(1, length(x||y)+1)) i from t)),
p as (select distinct a.k ka, b.k kb from g a join g b on a.g = b.g where a.k < b.k),
q as (select p.*, greatest(length(a.x||a.y), length(b.x||b.y)) n, a.x||a.y a1, a.y||a.x a2, b.x||b.y b1, b.y||b.x b2 from p join t a on a.k = ka join t b on b.k = kb where abs(length(a.x||a.y) - length(b.x||b.y)) <= 0.06 * greatest(length(a.x||a.y), length(b.x||b.y)) + 1e-9),
v as (select ka, kb from q where least(levenshtein(a1,b1), levenshtein(a1,b2), levenshtein(a2,b1), levenshtein(a2,b2)) <= floor(0.06::double * n + 1e-9)),
m as (select distinct id, k from r join t using (x, y)),
pairs as (select least(a.id,b.id) id_a, greatest(a.id,b.id) id_b from v join m a on a.k = ka join m b on b.k = kb where a.id <> b.id union select a.id, b.id from m a join m b on a.k = b.k where a.id < b.id)"""

P5_FOUND = f"with {_RECORDS} select id_a, id_b from pairs"

_TRIM = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_FOLDS = f"""f as (select scheme, id, fold from (select *, row_number() over (partition by scheme, id order by assigned_at desc nulls last, fold desc nulls last) rn from (select scheme, {_TRIM.format('id')} id, fold, assigned_at from folds where scheme is not null and id is not null)) where rn = 1 and fold is not null),
found as (select a.scheme, id_a, id_b, a.fold fold_a, b.fold fold_b from pairs join f a on a.id = id_a join f b on b.id = id_b and a.scheme = b.scheme where a.fold <> b.fold)"""

P4_FOUND = f"with {_RECORDS}, {_FOLDS} select scheme, id_a, id_b from found"

P4_COUNTS = f"""with {_RECORDS}, {_FOLDS}, s as (select scheme, fold_a fold, id_a id from found union all select scheme, fold_b, id_b from found), o as (select id, min(source) source from dev where id is not null group by 1)
select scheme, fold, source, count(*) n_pairs, count(distinct id) n_records from s join o using (id) group by 1, 2, 3"""

_KNOWN_FOLDS = _FOLDS[: _FOLDS.index("found as")].rstrip().rstrip(",")
P4_COVERAGE = f"""with {_KNOWN_FOLDS}, t as (select id, c, min(t) t from (select id, 0 c, {_letters('heavy')} t from dev where id is not null union all select id, 1, {_letters('light')} from dev where id is not null) group by 1, 2),
u as (select scheme, id, c, fold, t from t join f using (id) where length(t) >= 24), x as (select scheme, id, c, fold, i, t[i:i+23] g from (select *, unnest(range(1, length(t)-22)) i from u)),
h as (select * from x semi join (select scheme, g from x group by 1, 2 having min(fold) <> max(fold)) y on x.scheme = y.scheme and x.g = y.g),
v as (select scheme, id, c, sum(least(24, coalesce(i - p, 24))) covered from (select *, lag(i) over (partition by scheme, id, c order by i) p from h) group by 1, 2, 3),
r as (select scheme, id, max(fold) fold, sum(length(t)) letters, coalesce(sum(covered), 0) covered from u left join v using (scheme, id, c) group by 1, 2), o as (select id, min(source) source from dev where id is not null group by 1)
select scheme, fold, source, count(*) n_records, count(*) filter (covered > 0) n_touched, count(*) filter (covered*2 >= letters) n_half, round(sum(covered)/sum(letters), 6) share from r join o using (id) group by 1, 2, 3"""


def _quoted(c: str | None) -> str:
    return "null" if c is None else "'" + c.replace("'", "''") + "'" if ord(c[0]) >= 32 and len(c) else f"chr({ord(c)})"


def _forms() -> str:
    table = {**_table(), **{n: None for n in (*range(1, 9), *range(0x0E, 0x20), 0x7F)}}
    values = ",".join(f"({n},{_quoted(v)})" for n, v in sorted(table.items()))
    return f"""m(c, r) as (values {values}), d as (select doc_id, text from documents where text is not null),
x as (select doc_id, unnest(regexp_extract_all(text, '(?s).')) c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) i from d where text <> ''),
f as (select doc_id, nfc_normalize(coalesce(string_agg(case when m.c is null then x.c else m.r end, '' order by i), '')) form from x left join m on m.c = unicode(x.c) group by 1)"""


def p9_canonical() -> str:
    return f"with {_forms()} select doc_id, case when text is null then null when text = '' then '' else form end canonical from documents left join f using (doc_id)"


def p9_found() -> str:
    return f"""with {_forms()}, t as (select doc_id, text, form from f join d using (doc_id) where regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]'))
select a.doc_id doc_id_a, b.doc_id doc_id_b from t a join t b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""
