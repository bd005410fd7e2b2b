"""SQL that computes from the driver's tables what the queries compute from the records."""

from __future__ import annotations

from ..functions.columns import ENTITIES

_NL = "chr(10)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dec(e: str) -> str:
    """Named entities decoded, one after another."""
    for name, value in ENTITIES:
        e = f"replace({e}, {_lit(name)}, {_lit(value)})"
    return e


def squeezed(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


#: One row a document: what its record says.
FACTS = f"""
base AS (SELECT doc_id, doc_id % 6 AS m, doc_id // 6 AS turn, lpad(cast(doc_id + 1000000 AS varchar), 8, '0') AS number, cast(doc_id + 1000000 AS varchar) AS short,
    'Item ' || coalesce(source, '') || ' & <' || coalesce(lang, '') || '>' AS title, list_filter(string_split(coalesce(text, ''), {_NL}), lambda x: trim(x) <> '') AS lines FROM documents),
edge AS (SELECT l_orderkey AS doc_id, list({{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'parent': lpad(cast(l_partkey % 100 AS varchar), 2, '0') || '/' || lpad(cast(l_suppkey AS varchar), 6, '0'), 'date': strftime(l_shipdate, '%Y%m%d')}}
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS edges FROM lineitem GROUP BY ALL),
d AS (SELECT base.*, CASE WHEN m IN (1, 3) THEN 'A1' ELSE ['B1', 'B2', 'E1', 'S1'][turn % 4 + 1] END AS kind, coalesce(strftime(o_orderdate, '%Y%m%d'), '') AS filed, coalesce(lines[1], '') AS first, lines[2:4] AS said, lines[5:] AS rest,
    coalesce(c_name, '') AS buyer, coalesce(s_name, '') AS seller, coalesce(p_brand || '  ' || p_type, '') AS class, coalesce(edges, []) AS edges, ['', 'D', 'RE', 'PP'][turn % 4 + 1] AS prefix
    FROM base LEFT JOIN orders ON o_orderkey = base.doc_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN edge ON edge.doc_id = base.doc_id LEFT JOIN part ON p_partkey = edges[1].p LEFT JOIN supplier ON s_suppkey = edges[1].s)"""

_GOOD = "m < 5"
#: Identifiers and dates.
_NUMBER = "CASE m WHEN 4 THEN prefix || short ELSE number END"
_KIND = "CASE m WHEN 4 THEN ['B1', 'S', 'E', NULL][turn % 4 + 1] ELSE kind END"
_PATENT = "CASE WHEN m IN (0, 2) AND kind <> 'S1' THEN 'US' || short || kind WHEN m = 4 AND turn % 4 < 3 THEN 'US' || prefix || short || ['B1', 'S', 'E'][turn % 4 + 1] END"
_PUBLICATION = "CASE WHEN m IN (1, 3) OR (m IN (0, 2) AND kind = 'S1') THEN 'US' || number || kind WHEN m = 4 AND turn % 4 = 3 THEN 'US' || prefix || short END"
_SERIAL = "CASE m WHEN 2 THEN short WHEN 3 THEN '10' || substr(number, 3) ELSE number END"
_LABEL = "CASE m WHEN 2 THEN short WHEN 3 THEN '10/' || substr(number, 3) WHEN 4 THEN number ELSE '01/' || CASE WHEN starts_with(number, '01') THEN substr(number, 3) ELSE number END END"
_FILED = "nullif(filed, '')"
_FORMAT = "CASE m WHEN 0 THEN 'UsptoGrantV4' || turn % 8 WHEN 1 THEN 'UsptoApplicationV4' || turn % 7 WHEN 2 THEN 'UsptoGrantV25' WHEN 3 THEN 'UsptoApplicationV1' || 5 + turn % 2 WHEN 4 THEN 'UsptoGrantApsGreenBook' ELSE CASE WHEN turn % 5 = 4 THEN 'UsptoGrantV45' END END"
_ERROR = "CASE WHEN m < 5 THEN NULL WHEN turn % 5 < 3 THEN 'UnsupportedRoot' WHEN turn % 5 = 3 THEN 'ConflictingVersionMarkers' END"
#: Lists.
_IPC = "CASE m WHEN 2 THEN ['A01B  1/02'] WHEN 3 THEN ['A01B ' || turn] WHEN 4 THEN ['A42B 300', 'A42B 124'] ELSE ['A01B' || turn || '/02'] END"
_US = f"CASE WHEN m IN (2, 3) THEN list_filter([class], lambda x: x <> '') WHEN m = 4 THEN list_filter([{squeezed('class')}, '2423'], lambda x: x <> '') ELSE list_filter([class, '2423'], lambda x: x <> '') END"
_APPLICANTS = "CASE m WHEN 2 THEN [trim('Ann ' || buyer)] WHEN 3 THEN [] WHEN 4 THEN [] ELSE list_filter([buyer], lambda x: x <> '') END"
_ASSIGNEES = "CASE m WHEN 2 THEN list_filter([seller], lambda x: x <> '') WHEN 3 THEN [trim(seller || ' <Inc>')] WHEN 4 THEN [seller] ELSE [trim('Cy D. ' || seller)] END"
_INVENTORS = "CASE m WHEN 2 THEN [] WHEN 3 THEN [trim('Ann ' || buyer), 'Bo'] WHEN 4 THEN [trim('Ann ' || buyer), 'Bo'] ELSE [trim('Ann ' || buyer), trim('Bo ' || buyer)] END"
_RELATION = "CASE m WHEN 3 THEN CASE i WHEN 0 THEN 'continuation-of' WHEN 1 THEN 'continuations' END WHEN 2 THEN CASE i WHEN 0 THEN 'us-provisional-application' ELSE 'parent-us' END ELSE CASE i WHEN 0 THEN 'us-provisional-application' WHEN 1 THEN 'continuation' ELSE 'division' END END"
_CHILD = "CASE WHEN m = 3 OR i = 0 THEN NULL ELSE number END"
_KEPT = "CASE m WHEN 3 THEN edges[1:2] WHEN 4 THEN [] WHEN 5 THEN [] ELSE edges END"
_PRIORITY = f"list_min(list_transform({_KEPT}, lambda e: e.date))"
#: Body.
_PARA = lambda what, mark: f"array_to_string(list_transform({what}, lambda x, i: {_NL} || {_NL} || {mark} || trim({dec('x')})), '')"
_N = lambda by: f"'[' || lpad(cast(i + {by} AS varchar), 4, '0') || '] '"
_SUMMARY = f"'## Summary Of The Invention' || {_NL} || '### BACKGROUND'"
_DETAILED = "'## Description Of The Invention'"
_DESCRIPTION = f"""CASE WHEN m < 2 THEN '<?BRFSUM description="Brief Summary" end="lead"?>' || {_NL} || {_NL} || {_SUMMARY} || {_PARA('rest[:2]', _N(0))} || {_NL} || {_NL} || '<?BRFSUM description="Brief Summary" end="tail"?>' || {_NL} || {_NL} || '<?DETDESC description="Detailed" end="lead"?>' || {_NL} || {_NL} || {_DETAILED} || {_PARA('rest[3:]', _N(2))} || {_NL} || '<table a="1"><row></row></table>'
    WHEN m = 2 THEN {_SUMMARY} || {_PARA('rest[:2]', "''")} || {_NL} || {_NL} || {_DETAILED} || {_PARA('rest[3:]', "''")} || {_NL} || '<CWU><X></X></CWU>'
    WHEN m = 3 THEN '## Cross-Reference To Related Applications' || {_NL} || {_NL} || 'See others.' || {_NL} || {_NL} || {_SUMMARY} || {_PARA('rest[:2]', _N(0))} || {_NL} || '<paragraph>loose</paragraph>' || {_NL} || {_NL} || {_DETAILED} || {_PARA('rest[3:]', _N(2))}
    WHEN m = 4 THEN {_SUMMARY} || {_PARA('rest[:2]', "''")} || {_NL} || {_NL} || {_DETAILED} || {_PARA('rest[3:]', "''")} || {_NL} || {_NL} || '```' || {_NL} || '1   2' || {_NL} || '---' || {_NL} || '3   4' || {_NL} || '```' END"""
_FIRST = f"CASE WHEN trim(first) <> '' THEN {dec('first')} || {_NL} || {_NL} ELSE '' END"
_ABSTRACT = f"""CASE m WHEN 2 THEN {_FIRST} || 'Made of steel!' WHEN 3 THEN {_FIRST} || 'Made of steel and H<subscript>2</subscript>O.' WHEN 4 THEN {dec("trim(first || ' goes on.')")} ELSE {_FIRST} || 'Made of steel and H<sub>2</sub>O, "pure".' END"""
_APART = f"{_NL} || {_NL}"
_MD_FIRST = f"CASE WHEN m < 2 THEN {_APART} || trim('[0000] ' || {dec('first')}) WHEN trim(first) <> '' THEN {_APART} || trim({dec('first')}) ELSE '' END"
_MD_ABSTRACT = f"""'## Abstract' || CASE m WHEN 2 THEN {_MD_FIRST} || {_APART} || 'Made of **steel***!*' WHEN 3 THEN {_MD_FIRST} || {_APART} || 'Made of **steel** and *H<subscript>2</subscript>O*.' WHEN 4 THEN {_APART} || {dec("trim(first || ' goes on.')")} ELSE {_MD_FIRST} || {_APART} || 'Made of **steel** and *H<sub>2</sub>O*, "pure".' END"""
_SAID = f"CASE m WHEN 2 THEN {dec('x')} || 'bolda step.' WHEN 3 THEN {dec("'1. ' || x")} || 'wherein claim 1 turns.' WHEN 4 THEN {dec("i || '. ' || x || ' and more'")} || 'a step.' ELSE CASE i WHEN 1 THEN {dec("'1. ' || x")} || 'wherein  it turns.' ELSE 'The thing of claim 1' || {dec("', ' || x")} END END"
_CLAIM = f"CASE WHEN m = 3 THEN {squeezed(dec("'1. ' || x"))} || {_NL} || '  wherein claim 1 turns.' WHEN m < 2 AND i = 1 THEN {squeezed(dec("'1. ' || x"))} || {_NL} || '  wherein it turns.' ELSE {squeezed(_SAID)} END"
_MD_CLAIMS = f"""CASE WHEN m = 4 AND len(said) = 0 THEN '' ELSE '## Claims' || CASE m WHEN 2 THEN {_NL} || 'What is claimed is:' WHEN 3 THEN {_NL} || 'We claim' ELSE '' END
    || array_to_string(list_transform(said, lambda x, i: {_NL} || '```claim' || {_NL} || {_CLAIM} || {_NL} || '```'), '') || CASE WHEN m < 2 THEN {_NL} || '```claim' || {_NL} || {_NL} || '```' ELSE '' END END"""


def _yaml(name: str, value: str) -> str:
    return f"'{name}: ' || coalesce({value}, 'null') || {_NL}"


def _yaml_list(name: str, value: str) -> str:
    return f"'{name}:' || CASE WHEN len({value}) > 0 THEN array_to_string(list_transform({value}, lambda x: {_NL} || '  - ' || x), '') ELSE ' []' END || {_NL}"


def _bare(e: str) -> str:
    return f"coalesce(nullif(ltrim(replace({e}, '/', ''), '0'), ''), '0')"


_CHAIN = f"list_transform({_KEPT}, lambda e, j: {_RELATION.replace(' i ', ' (j - 1) ')} || {_NL} || '    parent_doc_number: ' || {_bare('e.parent')} || {_NL} || '    parent_date: ' || e.date || {_NL} || '    child_doc_number: ' || coalesce({_CHILD.replace(' i ', ' (j - 1) ')}, 'null'))"
_FRONT = f"""'---' || {_NL} || {_yaml('filing_date', _FILED)} || {_yaml('application_number', _LABEL)} || {_yaml('publication_number', _PUBLICATION)} || {_yaml('publication_date', _FILED)} || {_yaml('patent_number', _PATENT)} || {_yaml('priority_date', _PRIORITY)}
    || {_yaml_list('ipc_classifications', _IPC)} || {_yaml_list('us_classifications', _US)} || {_yaml_list('priority_chain', f"list_transform({_CHAIN}, lambda z: 'relationship: ' || z)")} || {_yaml_list('applicants', _APPLICANTS)} || {_yaml_list('assignees', _ASSIGNEES)} || '---'"""
_TITLE = "'# ' || title"
#: The parts one after another, empty ones without a trace.
_WHOLE = f"trim({_FRONT} || {_APART} || {_TITLE} || {_APART} || {_MD_ABSTRACT} || {_APART} || ({_DESCRIPTION}) || {_APART} || {_MD_CLAIMS}, ' ' || {_NL})"
_OWN_KEY = "CASE WHEN m < 2 THEN 'US' || number || '-X' WHEN m = 3 THEN number WHEN m = 4 THEN prefix || short ELSE cast(doc_id + 1 AS varchar) END"


def _sql(body: str) -> str:
    return f"WITH {FACTS} {body}"


_SHARD = "'ipg' || doc_id % 8"
_JOINED = lambda e: f"array_to_string({e}, '|')"
_SKIPS = "count(*) FILTER (m < 5) AS {0}, count(*) FILTER (m = 5 AND turn % 5 < 2) AS {1}, count(*) FILTER (m = 5 AND turn % 5 IN (2, 3)) AS {2}, count(*) FILTER (m = 5 AND turn % 5 = 4) AS {3}"
_FIELDS = f"{_NUMBER} AS doc_number, {_KIND} AS kind_code, {_PUBLICATION} AS publication_number, {_PATENT} AS patent_number, {_FILED} AS publication_date, {_SERIAL} AS application_number, {_FILED} AS filing_date, title AS invention_title"
_LISTS = f"{_JOINED(_APPLICANTS)} AS applicant_names, {_JOINED(_ASSIGNEES)} AS assignee_names, {_JOINED(_INVENTORS)} AS inventor_names, {_JOINED(_IPC)} AS ipc_classifications, {_JOINED(_US)} AS us_classifications, {_PRIORITY} AS priority_date"
_EDGES = f"FROM (SELECT *, unnest(range(len({_KEPT}))) AS i, unnest({_KEPT}) AS e FROM d WHERE m < 4)"
_ESCAPED = "text"
for _a, _b in (("\\", "\\\\"), ('"', '\\"')):
    _ESCAPED = f"replace({_ESCAPED}, {_lit(_a)}, {_lit(_b)})"
for _c, _b in ((8, "\\u0008"), (9, "\\t"), (10, "\\n"), (12, "\\u000c"), (13, "\\r"), (31, "\\u001f"), (127, "\\u007f"), (133, "\\u0085")):
    _ESCAPED = f"replace({_ESCAPED}, chr({_c}), {_lit(_b)})"
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"
_BUCKETS = "[['summary', 'section'], ['summary', 'heading']]"

#: The archives: records that are skipped apart, tagged text apart, the others by doc_id; equal names keep their folders.
_APART = "m = 5 AND turn % 5 < 4 AND (doc_id // 30) % 2 = 0"
_ZIPS = f"""z AS (SELECT *, CASE WHEN {_APART} THEN 'odd' ELSE 'week' || (doc_id // 4) % 2 END AS folder,
    CASE WHEN {_APART} THEN 'ipgskipped' ELSE CASE WHEN m = 4 THEN 'pftaps' ELSE 'ipg' END || doc_id % 4 END AS stem FROM d),
named AS (SELECT stem, count(DISTINCT folder) AS folders FROM z GROUP BY ALL),
y AS (SELECT z.*, CASE WHEN folders > 1 THEN folder || '/' || stem ELSE stem END AS shard FROM z JOIN named USING (stem))"""

ORACLE = {
    "formats": _sql(f"SELECT doc_id, {_FORMAT} AS source_format, {_ERROR} AS error_kind FROM d"),
    "page_formats": "SELECT 'UnsupportedRoot' AS error_kind, 'html' AS error_msg, count(*) AS pages FROM pages",
    "biblio": _sql(f"SELECT doc_id, {_FORMAT} AS source_format, 'US' AS country_code, {_FIELDS} FROM d WHERE {_GOOD}"),
    "party_names": _sql(f"""SELECT doc_id, role, cast(i - 1 AS integer) AS pos, names[i] AS name, role = 'inventor' AND i = 1 AND m IN (3, 4) AS first_named FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM (
        SELECT doc_id, m, 'applicant' AS role, {_APPLICANTS} AS names FROM d WHERE {_GOOD} UNION ALL SELECT doc_id, m, 'assignee', {_ASSIGNEES} FROM d WHERE {_GOOD} UNION ALL SELECT doc_id, m, 'inventor', {_INVENTORS} FROM d WHERE {_GOOD}))"""),
    "classifications": _sql(f"SELECT doc_id, {_JOINED(_IPC)} AS ipc, {_JOINED(_US)} AS us FROM d WHERE {_GOOD}"),
    "priority": _sql(f"SELECT doc_id, cast(i AS integer) AS pos, {_RELATION} AS relationship, e.parent AS parent_doc_number, e.date AS parent_date, {_CHILD} AS child_doc_number {_EDGES}"),
    "priority_dates": _sql(f"SELECT doc_id, {_PRIORITY} AS priority_date FROM d WHERE {_GOOD}"),
    "claims": _sql(f"SELECT doc_id, cast(i AS integer) AS number, trim({_SAID}) AS text FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i, unnest(said) AS x FROM d WHERE {_GOOD})"),
    "claim_counts": _sql(f"SELECT {_FORMAT} AS source_format, cast(sum(len(said)) AS bigint) AS claims, cast(max(len(said)) AS bigint) AS most FROM d WHERE {_GOOD} GROUP BY ALL"),
    "abstracts": _sql(f"SELECT doc_id, {_ABSTRACT} AS abstract_text FROM d WHERE {_GOOD}"),
    "abstract_blocks": _sql(f"SELECT doc_id, {_MD_ABSTRACT} AS abstract FROM d WHERE {_GOOD}"),
    "descriptions": _sql(f"SELECT doc_id, {_DESCRIPTION} AS description FROM d WHERE {_GOOD}"),
    "description_parts": _sql(f"""SELECT source_format, bucket, kind, count(*) AS items FROM (SELECT {_FORMAT} AS source_format, unnest(CASE WHEN m < 2 THEN ['other/opaque', 'other/opaque', 'other/opaque', 'summary/section', 'summary/heading', 'detailed/section', 'detailed/opaque'] WHEN m = 2 THEN ['summary/section', 'summary/heading', 'detailed/section', 'detailed/opaque']
        WHEN m = 3 THEN ['cross-reference/section', 'cross-reference/heading', 'cross-reference/paragraph', 'summary/section', 'summary/heading', 'summary/opaque', 'detailed/section'] ELSE ['summary/section', 'summary/heading', 'detailed/section', 'detailed/paragraph'] END
        || list_transform(rest, lambda x, i: CASE WHEN i < 3 THEN 'summary/paragraph' ELSE 'detailed/paragraph' END)) AS what FROM d WHERE {_GOOD}), LATERAL (SELECT split_part(what, '/', 1) AS bucket, split_part(what, '/', 2) AS kind) GROUP BY ALL"""),
    "claim_blocks": _sql(f"SELECT doc_id, {_MD_CLAIMS} AS claims FROM d WHERE {_GOOD}"),
    "frontmatter": _sql(f"SELECT doc_id, {_FRONT} AS frontmatter FROM d WHERE {_GOOD}"),
    "markdown": _sql(f"SELECT doc_id, {_TITLE} || {_NL} || {_NL} || {_MD_ABSTRACT} AS markdown FROM d WHERE {_GOOD}"),
    "whole_documents": _sql(f"SELECT doc_id, {_WHOLE} AS markdown FROM d WHERE {_GOOD}"),
    "drawings": _sql("SELECT doc_id, kind, CASE WHEN m < 2 THEN '00001' END AS num, CASE WHEN kind = 'figure' THEN number || '-D1.TIF' END AS file, CASE kind WHEN 'heading' THEN 'Figs' WHEN 'representative-figure' THEN '1' END AS text FROM (SELECT doc_id, m, number, unnest(CASE WHEN m = 3 THEN ['heading', 'representative-figure', 'figure'] ELSE ['figure'] END) AS kind FROM d WHERE m < 4)"),
    "manifest": _sql(f"SELECT {_SHARD} AS shard, {_SKIPS.format('written', 'supplemental', 'unsupported', 'malformed')} FROM d GROUP BY ALL"),
    "limited": _sql(f"SELECT shard, doc_id FROM (SELECT {_SHARD} AS shard, doc_id, coalesce(sum(cast(m < 5 AS integer)) OVER (PARTITION BY doc_id % 8 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM d) WHERE n < 5"),
    "doc_keys": _sql(f"SELECT doc_id, {_OWN_KEY} AS doc_key FROM d"),
    "unsupported_lines": _sql(f"SELECT {_SHARD} AS shard, doc_id AS ordinal, ({_OWN_KEY}) || chr(9) || 'source detection failed: ' || CASE turn % 5 WHEN 2 THEN 'unsupported XML root ''other''' ELSE 'conflicting XML version markers' END AS line FROM d WHERE m = 5 AND turn % 5 IN (2, 3)"),
    "manifest_lines": _sql(f"""SELECT shard, array_to_string(['{{', '  "format_version": 1,', '  "stem": "' || shard || '",', '  "source_file": "' || shard || '.zip",', '  "doc_kind": "grant",', '  "patents_written": ' || w || ',', '  "supplemental_skipped": ' || s || ',', '  "unsupported_skipped": ' || u || ',', '  "malformed_skipped": ' || b, '}}'], chr(10)) AS line
        FROM (SELECT {_SHARD} AS shard, {_SKIPS.format('w', 's', 'u', 'b')} FROM d GROUP BY ALL)"""),
    "json_lines": _sql(f"SELECT {_SHARD} AS shard, doc_id AS ordinal, {_OWN_KEY} AS doc_key, 'grant' AS doc_kind, {_SHARD} || '.zip' AS source_file, 'US' AS country_code, {_FIELDS}, {_LISTS} FROM d WHERE {_GOOD}"),
    "json_strings": f"SELECT doc_id, '{{\"x\":\"' || {_ESCAPED} || '\"}}' AS line FROM (SELECT doc_id, chr(8) || chr(12) || chr(31) || chr(127) || chr(133) || '\\b\\' || coalesce(text, '') AS text FROM documents)",
    "rewritten": _sql(f"SELECT doc_id, {_FORMAT} AS source_format, {_FIELDS}, {_LISTS}, {_ABSTRACT} AS abstract_text, len(said) AS claims, {_DESCRIPTION} AS description FROM d WHERE m < 4"),
    "split_records": _sql(f"SELECT 'ipg' || doc_id // 60 AS file, cast(row_number() OVER (PARTITION BY doc_id // 60 ORDER BY doc_id) - 1 AS integer) AS ordinal, {_OWN_KEY.replace('cast(doc_id + 1 AS varchar)', 'NULL')} AS doc_key FROM d WHERE m < 4 OR (m = 5 AND turn % 5 < 3)"),
    "split_tagged": _sql("SELECT 'pftaps' || doc_id // 60 AS file, cast(row_number() OVER (PARTITION BY doc_id // 60 ORDER BY doc_id) - 1 AS integer) AS ordinal, prefix || short AS doc_key FROM d WHERE m = 4"),
    "tagged_fields": _sql("""SELECT doc_id, section, tag, count(*) AS n FROM (SELECT doc_id, unnest(['PATN/WKU', 'PATN/SRC', 'PATN/APN', 'PATN/APT', 'PATN/TTL', 'PATN/ISD', 'PATN/APD', 'INVT/NAM', 'INVT/CTY', 'INVT/NAM', 'ASSG/NAM', 'ASSG/COD', 'CLAS/OCL', 'CLAS/XCL', 'CLAS/ICL', 'CLAS/ICL', 'ABST/PAL', 'BSUM/PAC', 'DETD/TBL', 'CLMS/STM']
        || list_transform(rest, lambda x, i: CASE WHEN i < 3 THEN 'BSUM/PAR' ELSE 'DETD/PAR' END) || list_transform(said, lambda x: 'CLMS/NUM') || list_transform(said, lambda x: 'CLMS/PAR') || list_transform(said, lambda x: 'CLMS/PA1')) AS what FROM d WHERE m = 4), LATERAL (SELECT split_part(what, '/', 1) AS section, split_part(what, '/', 2) AS tag) GROUP BY ALL"""),
    "tagged_values": _sql("""SELECT doc_id, tag, array_to_string(x, '|') AS joined FROM (SELECT doc_id, unnest([{'tag': 'TBL', 'x': ['1   2' || chr(10) || '---' || chr(10) || '3   4']}, {'tag': 'ICL', 'x': ['A42B  300', 'A42B 124']},
        {'tag': 'PAL', 'x': [rtrim(first) || CASE WHEN rtrim(first) = '' THEN '' ELSE ' ' END || 'goes on.']},
        {'tag': 'PAR', 'x': list_transform(rest, lambda x: rtrim(x)) || list_transform(said, lambda x, i: rtrim(i || '. ' || x) || ' and more')}]) AS t FROM d WHERE m = 4), LATERAL (SELECT t.tag AS tag, t.x AS x) WHERE len(x) > 0"""),
    "tagged_inventors": _sql("""SELECT doc_id, cast(i AS integer) AS pos, CASE i WHEN 0 THEN nullif(trim(buyer), '') ELSE 'Bo' END AS last_name, CASE i WHEN 0 THEN 'Ann' END AS first_name,
        CASE i WHEN 0 THEN 'Town' END AS city, NULL::varchar AS state, NULL::varchar AS country, i = 0 AS first_named FROM (SELECT *, unnest(range(2)) AS i FROM d WHERE m = 4)"""),
    "tagged_claims": _sql(f"SELECT doc_id, cast(i AS integer) AS number, trim({_SAID}) AS text FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i, unnest(said) AS x FROM d WHERE m = 4)"),
    "elements_below": _sql("""SELECT doc_id, name, n FROM (SELECT doc_id, unnest(CASE m WHEN 2 THEN [{'name': 'CLM', 'n': k}, {'name': 'PARA', 'n': k}, {'name': 'PTEXT', 'n': 2 * k}, {'name': 'PDAT', 'n': 3 * k}, {'name': 'BOLD', 'n': k}, {'name': 'CLMSTEP', 'n': k}]
        WHEN 3 THEN [{'name': 'heading', 'n': 1}, {'name': 'claim', 'n': k}, {'name': 'claim-text', 'n': 3 * k}, {'name': 'dependent-claim-reference', 'n': k}]
        ELSE [{'name': 'claim', 'n': k + 1}, {'name': 'claim-text', 'n': k + least(k, 1)}, {'name': 'b', 'n': greatest(k - 1, 0)}, {'name': 'claim-ref', 'n': greatest(k - 1, 0)}] END) AS x
        FROM (SELECT doc_id, m, cast(len(said) AS bigint) AS k FROM d WHERE m < 4)), LATERAL (SELECT x.name AS name, x.n AS n) WHERE n > 0"""),
    "element_paths": _sql(f"""SELECT doc_id, CASE m WHEN 0 THEN 'us-patent-grant' WHEN 1 THEN 'us-patent-application' WHEN 2 THEN 'PATDOC' ELSE 'patent-application-publication' END AS root,
        CASE m WHEN 0 THEN 'lang=EN dtd-version=v4' || CASE WHEN turn % 8 = 0 THEN '' ELSE '.' END || turn % 8 || ' file=US' || number || '-X.XML' WHEN 1 THEN 'lang=EN dtd-version=v4.' || turn % 7 || ' file=US' || number || '-X.XML' WHEN 2 THEN 'DTD=2.5' ELSE '' END AS attributes,
        replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title FROM d WHERE m < 4"""),
    "prologs": _sql("""SELECT doc_id, CASE WHEN m < 4 OR (m = 5 AND turn % 5 < 3) THEN '1.0' END AS xml_version, CASE WHEN m < 2 THEN 'UTF-8' END AS encoding, NULL::varchar AS standalone,
        CASE WHEN m = 0 THEN 'us-patent-grant' WHEN m = 1 THEN 'us-patent-application' WHEN m = 2 THEN 'PATDOC' WHEN m = 3 THEN 'patent-application-publication' WHEN m = 5 AND turn % 5 = 3 THEN 'us-patent-application' END AS doctype, NULL::varchar AS public_id,
        CASE WHEN m = 0 THEN 'us-patent-grant-v4' || turn % 8 || '.dtd' WHEN m = 1 THEN 'us-patent-application-v4' || turn % 7 || '.dtd' WHEN m = 2 THEN 'ST32-US-Grant-025xml.dtd' WHEN m = 3 THEN CASE WHEN turn % 2 = 0 THEN 'pap-v15-2001-01-31.dtd' ELSE 'pap-v16-2002-01-01.dtd' END END AS system_id,
        CASE WHEN m < 2 THEN ' ' WHEN m = 3 THEN '' END AS subset FROM d"""),
    "shard_roundtrip": _sql(f"SELECT {_OWN_KEY} AS doc_key, md5({_WHOLE}) AS text_md5 FROM d WHERE {_GOOD}"),
    "shard_parts": _sql(f"SELECT {_SHARD} AS shard, count(*) AS documents, 2::bigint AS same_files FROM d WHERE {_GOOD} GROUP BY ALL"),
    "pointers": _sql(f"SELECT {_SHARD} AS shard, {_OWN_KEY} AS doc_key, {_PATENT} AS patent_number, cast(row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS bigint) AS documents_before FROM d WHERE {_GOOD}"),
    "bucketed_pointers": _sql(f"SELECT {_SHARD} AS shard, {_OWN_KEY} AS doc_key, {_PATENT} AS patent_number, true AS has_frame FROM d WHERE {_GOOD}"),
    "looked_up": _sql(f"SELECT {_OWN_KEY} AS doc_key, md5({_WHOLE}) AS text_md5 FROM d WHERE m < 2 AND doc_id IN (SELECT c_custkey FROM customer)"),
    "archive_records": _sql(f""", {_ZIPS} SELECT shard, stem || '.zip' AS source_file, cast(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS integer) AS ordinal,
        {_OWN_KEY.replace('cast(doc_id + 1 AS varchar)', 'NULL')} AS doc_key FROM y"""),
    "archive_set": _sql(f""", {_ZIPS} SELECT *, written AS frames, unsupported AS listed FROM (SELECT shard, stem || '.zip' AS source_file, 'grant' AS doc_kind, {_SKIPS.format('written', 'supplemental', 'unsupported', 'malformed')} FROM y GROUP BY ALL)
        UNION ALL SELECT 'ipa' || r_regionkey, 'ipa' || r_regionkey || '.zip', 'application', 0, 0, 0, 0, 0, 0 FROM region"""),
    "by_application_number": _sql(f"SELECT doc_id, {_SERIAL} AS application_number, filed AS other_filed FROM d WHERE m IN (0, 1, 4)"),
    "identifiers": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p || coalesce(nullif(ltrim(n, '0'), ''), '0') AS number, CASE p WHEN 'D' THEN 'S' WHEN 'RE' THEN 'E' WHEN 'PP' THEN NULL ELSE 'B1' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN cast(l_suppkey AS varchar) ELSE l_suppkey || '7' END AS serial
        FROM (SELECT *, ['', 'D', 'RE', 'PP', 'H'][l_partkey % 5 + 1] AS p, lpad(cast(l_partkey AS varchar), 7, '0') AS n FROM lineitem)""",
    "labels_of_applications": """SELECT o_orderkey, CASE WHEN s = '' THEN n ELSE s || '/' || CASE WHEN length(n) >= 8 AND starts_with(n, s) THEN substr(n, length(s) + 1) ELSE n END END AS label, CASE WHEN length(n) < 8 THEN s || n ELSE n END AS bare, coalesce(nullif(ltrim(o_orderkey || lpad(cast(o_custkey AS varchar), 6, '0'), '0'), ''), '0') AS compact
        FROM (SELECT *, ['', '14', '1', '08'][o_custkey % 4 + 1] AS s, CASE WHEN o_orderkey % 3 = 0 THEN '14' || lpad(cast(o_orderkey AS varchar), 6, '0') ELSE cast(o_orderkey AS varchar) END AS n FROM orders)""",
    "entities": f"SELECT doc_id, {dec('t')} AS text FROM (SELECT doc_id, '&ldquo;' || coalesce(text, '') || '&rdquo;&amp;lt;&Prime;&deg;&eacute;' AS t FROM documents)",
    "blank_lines": "SELECT doc_id, trim(regexp_replace(chr(10) || replace(coalesce(text, ''), '. ', '.' || repeat(chr(10), cast(2 + doc_id % 4 AS integer))) || ' ', chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents",
    "decoded_lengths": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(coalesce(text, '')) ELSE strlen(coalesce(text, '')) + 1 END AS n_chars FROM documents",
    "archive_names": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN 'application' WHEN 4 THEN 'application' ELSE 'grant' END AS doc_kind, o_orderkey % 5 = 2 AND o_orderkey % 2 = 0 AS is_aps FROM orders",
    "concatenated_titles": _sql(f"SELECT sum(length({_TITLE})) + 4 * (count(*) - 1) AS n_chars, count(*) AS n_documents FROM d WHERE {_GOOD}"),
}
