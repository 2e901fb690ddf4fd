"""SQL building blocks for the DuckDB oracle queries.

Each registered query has an independent SQL formulation over the same
parquet tables; these helpers render the shared pieces (the article view,
rule tables as CASE expressions, text functions) as DuckDB SQL text.
"""

from __future__ import annotations

from presswork import rules as R

# Patterns of the SQL side, written on their own: those of the package are not imported, so that a wrong one shows.
WS_CLASS = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
LINE_BREAK = "\\x0D\\x0A|[\\x0A-\\x0D\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
TAG_RE = "<[^>]+>"
AUTHORITY = "^(?:[A-Za-z][-+.A-Za-z0-9]*:)?//([^/?#]*)"
URL_PARTS = "^(?:([A-Za-z][-+.A-Za-z0-9]*):)?(//([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(?:.*))?$"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WS_CLASS + '+')}, ' ', 'g'))"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


def lower0(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def url_cleanup(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"


def domain(x: str) -> str:
    return f"lower(regexp_extract({url_cleanup(x)}, {q(AUTHORITY)}, 1))"


def sentences(t: str) -> str:
    """Split cleaned text after . ! ? followed by a space (RE2 has no look-behind: mark, then split)."""
    return (f"list_filter(string_split(regexp_replace({t}, '([.!?]) ', '\\1' || chr(30), 'g'), chr(30)), "
            f"lambda s: s <> '')")


def words(x: str, min_len: int = 3) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), {q(R.WORD_CLASS + '{' + str(min_len) + ',}')}), lambda w: lower(w))"


def lines(x: str) -> str:
    return (f"list_filter(list_transform(string_split(regexp_replace(coalesce({x}, ''), {q(LINE_BREAK)}, chr(10), 'g'), chr(10)), "
            f"lambda l: {strip_ws('l')}), lambda l: l <> '')")


def clamp(x: str, n: int) -> str:
    ls, ss = lines(x), sentences(clean(x))
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' "
            f"WHEN len({ls}) >= 2 THEN array_to_string({ls}[1:{n}], chr(10)) "
            f"WHEN len({ss}) > 0 THEN trim(array_to_string({ss}[1:{n}], chr(10))) "
            f"ELSE left({clean(x)}, {R.CLAMP_FALLBACK_MAX}) END")


def any_contains(t: str, kws: list[str]) -> str:
    return " OR ".join(f"contains({t}, {q(k)})" for k in kws)


def category_case(t: str, rules=R.CATEGORY_RULES_A, default: str = "general") -> str:
    whens = " ".join(f"WHEN {any_contains(t, kws)} THEN {q(label)}" for label, kws in rules)
    return f"CASE {whens} ELSE {q(default)} END"


def score_sum(t: str, high=R.SEVERITY_HIGH_A, med=R.SEVERITY_MED_A) -> str:
    parts = [f"CASE WHEN contains({t}, {q(k)}) THEN {R.SEVERITY_HIGH_WEIGHT} ELSE 0 END" for k in high]
    parts += [f"CASE WHEN contains({t}, {q(k)}) THEN {R.SEVERITY_MED_WEIGHT} ELSE 0 END" for k in med]
    return "CAST((" + " + ".join(parts) + ") AS BIGINT)"


def severity_case(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {th} THEN {q(label)}" for th, label in R.SEVERITY_THRESHOLDS_A)
    return f"CASE {whens} ELSE {q(R.SEVERITY_FLOOR)} END"


def lookup_case(key: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {whens} ELSE {q(default)} END"


def soc_action_a(cat: str, sev: str) -> str:
    return (f"({lookup_case(cat, R.SOC_ACTIONS_A, R.SOC_ACTION_DEFAULT_A)} || "
            f"{lookup_case(sev, R.SOC_SUFFIX_A, R.SOC_SUFFIX_DEFAULT_A)})")


def sev_rank(sev: str, strip: bool = False) -> str:
    s = f"lower({'trim(' if strip else ''}coalesce({sev}, ''){')' if strip else ''})"
    whens = " ".join(f"WHEN {s} = {q(k)} THEN {v}" for k, v in R.SEVERITY_RANK.items())
    return f"CASE {whens} ELSE 0 END"


def md_guidance(sev: str, line: int) -> str:
    s = f"lower(coalesce({sev}, ''))"
    whens = " ".join(
        f"WHEN {s} IN ({', '.join(q(x) for x in labels)}) THEN {q(l1 if line == 1 else l2)}"
        for labels, l1, l2 in R.MD_GUIDANCE)
    return f"CASE {whens} ELSE {q(R.MD_GUIDANCE_DEFAULT[line - 1])} END"


def iso_ts(x: str, missing: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN {q(missing)} "
            f"WHEN microsecond({x}) % 1000000 = 0 THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END")


def or_default(x: str, d: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN {q(d)} ELSE {x} END"


ARTICLES_FX = f"""articles AS (
  SELECT d.doc_id AS arrival_id,
         d.source AS source,
         {domain('p.url')} AS domain,
         left({clean("split_part(d.text, chr(10), 1)")}, {R.TITLE_MAX}) AS title,
         p.url AS url,
         CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE e.ts END AS published_at,
         d.text AS content,
         CAST(NULL AS VARCHAR) AS summary,
         CAST(NULL AS VARCHAR) AS category,
         CAST(NULL AS VARCHAR) AS severity,
         CAST(NULL AS VARCHAR) AS soc_action
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
  LEFT JOIN events e ON e.event_id = d.doc_id
)"""


def window(since_hours: int = 24, src: str = "articles") -> str:
    return (f"win AS (SELECT * FROM {src} WHERE published_at IS NULL OR "
            f"published_at >= (SELECT max(published_at) FROM {src}) - INTERVAL {int(since_hours)} HOUR)")


def latest(limit: int = R.DEFAULT_LIMIT, src: str = "win") -> str:
    return (f"latest AS (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, arrival_id DESC) AS pos "
            f"FROM (SELECT * FROM {src} ORDER BY published_at DESC NULLS LAST, arrival_id DESC LIMIT {int(limit)}))")


def enrich_a(src: str = "latest") -> str:
    lt = lower0("title")
    ls = "lower(coalesce(title, '') || chr(10) || coalesce(content, ''))"
    return (f"enr0 AS (SELECT * EXCLUDE (category, severity, soc_action), {category_case(lt)} AS category, "
            f"{score_sum(ls)} AS severity_score FROM {src}), "
            f"enr1 AS (SELECT *, {severity_case('severity_score')} AS severity FROM enr0), "
            f"enr AS (SELECT *, {soc_action_a('category', 'severity')} AS soc_action FROM enr1)")


__all__ = ["ARTICLES_FX", "TAG_RE", "URL_PARTS"]
