"""Reference SQL (DuckDB dialect) for every catalogue query.

Written independently of the Spark path: membership is an IN list, the
blank test a regex match, audits and decision results are spelled out per
rule, and JSON round trips are replaced by the fields they carry.
"""

from __future__ import annotations

# --- fixed values, spelled out here so that a wrong table in the library can't pass both sides ---
MISSING = "isMissing"
GROUPS = {'Non UK': ('US', 'CH', 'MX', 'BR'),
 'UK & US': ('US', 'UK'),
 'Americas': ('US', 'MX', 'BR'),
 'Europe': ('CH',)}
SQL_SUITE_RULES = ((1, 'Non UK', 'sales'), (2, 'UK & US', 'marketing'), (3, 'Americas', 'hr'), (4, 'Europe', 'it'),
 (5, 'isMissing', 'ops'), (6, 'Non UK', 'marketing'), (7, 'UK & US', 'hr'), (8, 'Americas', 'it'),
 (9, 'Europe', 'sales'), (10, 'isMissing', 'sales'), (11, 'Non UK', 'it'), (12, 'UK & US', 'sales'),
 (13, 'Americas', 'marketing'), (14, 'Europe', 'hr'), (15, 'isMissing', 'hr'))
DECISION_SUITE_RULES = ((1, 'Non UK', 'sales'), (2, 'UK & US', 'marketing'), (3, 'Americas', 'hr'), (4, 'Europe', 'it'),
 (5, 'isMissing', 'ops'), (6, 'Non UK', 'marketing'), (7, 'UK & US', 'hr'), (8, 'Americas', 'it'),
 (9, 'Europe', 'sales'), (10, 'isMissing', 'sales'), (11, 'Non UK', 'sales'), (12, 'UK & US', 'hr'),
 (13, 'Americas', 'sales'), (14, 'Europe', 'hr'), (15, 'isMissing', 'hr'))
REGION_LOCATION = {0: 'US', 1: 'UK', 2: 'CH', 3: 'MX', 4: 'BR'}
SEGMENT_DEPARTMENT = {'AUTOMOBILE': 'sales', 'BUILDING': 'marketing', 'FURNITURE': 'hr', 'HOUSEHOLD': 'it', 'MACHINERY': 'ops'}
SEGMENT_GROUP = {"AUTOMOBILE": "Non UK", "BUILDING": "UK & US", "FURNITURE": "Americas", "HOUSEHOLD": "Europe",
                 "MACHINERY": "Asia"}
SEED_ROWS = (('US', 1, 'sales'), ('UK', 2, 'marketing'), ('CH', 3, 'hr'), ('MX', 4, 'it'), ('BR', 5, 'ops'))
PREFIXES = "abcdefghijklmnopqrstuvwxyz"
# --------------------------------------------------------------------------------------------------


def _s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _case(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {col} = {_s(k) if isinstance(k, str) else k} THEN {_s(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def _in(group: str, loc: str = "location") -> str:
    return f"({loc} IN ({', '.join(_s(m) for m in GROUPS[group])}))"


def _missing(v: str) -> str:
    return f"({v} IS NULL OR regexp_matches(CAST({v} AS VARCHAR), '^\\s*$'))"


def _pred(test: str, dept: str, loc="location", dep="department", id_="id") -> str:
    lhs = _missing(id_) if test == MISSING else _in(test, loc)
    return f"({lhs} AND {dep} = {_s(dept)})"


def _rules(table=SQL_SUITE_RULES, names="r{}", **kw) -> list[str]:
    return [f"{_pred(t, d, **kw)} AS {names.format(rid)}" for rid, t, d in table]


LOCATION = _case("n.n_regionkey", REGION_LOCATION)
DEPARTMENT = _case("c.c_mktsegment", SEGMENT_DEPARTMENT)

REC = f"""rec AS (
  SELECT c.c_custkey AS key, {LOCATION} AS location, n.n_name AS idPrefix, c.c_custkey AS id,
         CAST(c.c_nationkey AS BIGINT) AS page, {DEPARTMENT} AS department, c.c_mktsegment AS segment
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

EDGE = f"""edge AS (
  SELECT c.c_custkey AS key, c.c_acctbal AS balance,
         CASE WHEN c.c_acctbal >= 500 AND c.c_acctbal < 700 THEN ''
              WHEN c.c_acctbal >= 700 AND c.c_acctbal < 900 THEN '  '
              WHEN c.c_acctbal >= 900 AND c.c_acctbal < 1000 THEN 's'
              ELSE c.c_mktsegment END AS code,
         CASE WHEN c.c_acctbal < -500 THEN NULL ELSE {LOCATION} END AS location,
         n.n_name AS idPrefix,
         CASE WHEN c.c_acctbal >= 0 AND c.c_acctbal < 500 THEN NULL ELSE c.c_custkey END AS id,
         CAST(c.c_nationkey AS BIGINT) AS page,
         CASE WHEN c.c_acctbal >= -500 AND c.c_acctbal < 0 THEN NULL ELSE {DEPARTMENT} END AS department
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_letters = ", ".join(_s(c) for c in PREFIXES)
_seeds = ", ".join(f"({_s(loc)}, {page}, {_s(d)})" for loc, page, d in SEED_ROWS)
GEN = f"""gen AS (
  SELECT s.location, l.idPrefix, CAST(k.c_custkey AS INTEGER) AS id, CAST(s.page AS BIGINT) AS page, s.department
  FROM customer k
  CROSS JOIN (SELECT unnest([{_letters}]) AS idPrefix) l
  CROSS JOIN (VALUES {_seeds}) s(location, page, department))"""

GRP = f"""grp AS (
  SELECT key, location, {_case('segment', SEGMENT_GROUP)} AS grp FROM rec)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _json_text(cols: list[str]) -> str:
    parts = []
    for i, (name, c) in enumerate(cols):
        sep = "," if i else ""
        if name in ("id", "page"):
            parts.append(f"'{sep}\"{name}\":' || CAST({c} AS VARCHAR)")
        else:
            parts.append(f"'{sep}\"{name}\":\"' || {c} || '\"'")
    return "'{' || " + " || ".join(parts) + " || '}'"


_REC_JSON = _json_text([(n, n) for n in ("location", "idPrefix", "id", "page", "department")])


def _flag(v: str) -> str:
    return f"CASE WHEN {v} THEN 'true' WHEN NOT {v} THEN 'false' ELSE 'null' END"


def _any_failed(preds: list[str]) -> str:
    """array_contains(vector, false): TRUE if any FALSE, else NULL if any NULL, else FALSE."""
    anyf = " OR ".join(f"({p}) IS FALSE" for p in preds)
    anyn = " OR ".join(f"({p}) IS NULL" for p in preds)
    return f"CASE WHEN {anyf} THEN true WHEN {anyn} THEN NULL ELSE false END"


def _preds(table=SQL_SUITE_RULES, **kw) -> list[str]:
    return [_pred(t, d, **kw) for _, t, d in table]


def _audit(preds: list[str], compat: bool) -> str:
    top = _any_failed(preds)
    cols = [f"{top} AS overall", f"{top} AS set_result"]
    if compat:
        cols += [f"{preds[i + 1]} AS r{i}" for i in range(len(preds) - 1)] + [f"CAST(NULL AS BOOLEAN) AS r{len(preds) - 1}"]
    else:
        cols += [f"{p} AS r{i}" for i, p in enumerate(preds, 1)]
    return ", ".join(cols)


ORACLE: dict[str, str] = {}

ORACLE["gen_records"] = _w(GEN) + "SELECT location, idPrefix, id, page, department FROM gen"
_GEN_JSON = _json_text([(n, n) for n in ("location", "idPrefix", "id", "page", "department")])
ORACLE["copy_records"] = _w(GEN) + f"SELECT location, idPrefix, id, page, department, {_GEN_JSON} AS payload FROM gen"
ORACLE["parquet_roundtrip"] = ORACLE["copy_records"]
ORACLE["struct_payload_fields"] = _w(REC) + "SELECT key, location, idPrefix, id, page, department FROM rec"
ORACLE["json_payload"] = _w(REC) + f"SELECT key, {_REC_JSON} AS payload FROM rec"
ORACLE["json_parse"] = ORACLE["struct_payload_fields"]
ORACLE["suite_count"] = _w(REC) + (
    "SELECT count(*) AS rows, CAST(count_if(f) AS BIGINT) AS n_failed, CAST(count_if(NOT f) AS BIGINT) AS n_passed, "
    "CAST(count_if(f IS NULL) AS BIGINT) AS n_undecided"
    f" FROM (SELECT {_any_failed(_preds())} AS f FROM rec)")
ORACLE["suite_cache_count"] = ORACLE["suite_count"]
ORACLE["rule_single"] = _w(REC) + f"SELECT key, {_rules()[0]} FROM rec"
ORACLE["rule_vector"] = _w(REC) + f"SELECT key, {', '.join(_rules())} FROM rec"

_p = _preds()
ORACLE["rule_suite"] = _w(REC) + (
    f"SELECT key, {_any_failed(_p)} AS overall, {_any_failed(_p[:8])} AS set1, {_any_failed(_p[8:])} AS set2, "
    + ", ".join(_rules()) + " FROM rec")

_groups = list(GROUPS)
ORACLE["sql_function_rule"] = _w(REC) + (
    "SELECT key, " + ", ".join(f"{_in(g)} AS in_{i}" for i, g in enumerate(_groups, 1))
    + f", {_missing('id')} AS id_missing FROM rec")
ORACLE["named_list_rule"] = _w(REC) + f"SELECT key, {', '.join(_rules([r for r in SQL_SUITE_RULES if r[1] != MISSING]))} FROM rec"
ORACLE["rule_membership"] = _w(REC) + (
    "SELECT key, " + ", ".join(f"{_in(g)} AS in_{i}" for i, g in enumerate(_groups, 1)) + " FROM rec")
ORACLE["rule_missing"] = _w(EDGE) + (
    f"SELECT key, {_missing('id')} AS id_missing, {_missing('code')} AS code_missing, "
    f"{_missing('location')} AS location_missing FROM edge")
ORACLE["baseline_vector"] = _w(GEN) + f"SELECT id, idPrefix, location, {', '.join(_rules())} FROM gen"
ORACLE["rule_audit"] = _w(REC) + f"SELECT key, {_audit(_p, False)} FROM rec"
ORACLE["rule_audit_compat"] = _w(GEN) + f"SELECT id, idPrefix, location, {_audit(_p, True)} FROM gen"
ORACLE["audit_interim"] = _w(REC) + f"SELECT key, {_audit(_p, True)} FROM rec"
ORACLE["rule_runner"] = ORACLE["rule_audit"]
ORACLE["json_suite"] = ORACLE["rule_vector"]
ORACLE["json_baseline_vector"] = ORACLE["rule_vector"]
ORACLE["json_audit"] = ORACLE["audit_interim"]

_counts = " UNION ALL ".join(
    f"SELECT {rid} AS rule_id, count(*) FILTER (WHERE {p}) AS n_true, count(*) FILTER (WHERE NOT {p}) AS n_false, "
    f"count(*) FILTER (WHERE {p} IS NULL) AS n_null FROM rec"
    for (rid, _, _), p in zip(SQL_SUITE_RULES, _p))
ORACLE["rule_counts"] = _w(REC) + f"SELECT * FROM ({_counts})"
ORACLE["suite_metadata"] = _w(REC) + (
    "SELECT 1 AS suite_id, 1 AS suite_version, CASE WHEN rule_id <= 8 THEN 1 ELSE 2 END AS set_id, "
    "CASE WHEN rule_id <= 8 THEN 1 ELSE 3 END AS set_version, "
    "CASE WHEN rule_id <= 8 THEN rule_id ELSE rule_id - 8 END AS rule_id, "
    f"CASE WHEN rule_id <= 8 THEN 1 ELSE 2 END AS rule_version, n_true, n_false, n_null FROM ({_counts})")
ORACLE["wide_rule_counts"] = _w(EDGE) + " UNION ALL ".join(
    f"SELECT {100 + k} AS rule_id, count(*) FILTER (WHERE good % 80 = {k}) AS n_true, "
    f"count(*) FILTER (WHERE good % 80 <> {k}) AS n_false, count(*) FILTER (WHERE good IS NULL) AS n_null "
    "FROM (SELECT CASE WHEN balance < 0 THEN NULL ELSE id END AS good FROM edge)" for k in range(80))
_text = ("regexp_matches(CAST(id AS VARCHAR), '^[0-9]{3}$')", "regexp_matches(CAST(id AS VARCHAR), '^[0-9]{1,2}$')",
         "regexp_matches(idPrefix, '^[A-Z]{2,7}')", "'US' = location", "department <> '{department}'")
ORACLE["rule_text"] = _w(REC) + "SELECT key, " + ", ".join(
    f"{t} AS {b}{i}" for b in "fsj" for i, t in enumerate(_text, 1)) + " FROM rec"
ORACLE["stored_json_suite"] = (
    "SELECT event_id, k >= 50 AND event_type = 'click' AS r1, k % 2 = 0 AS r2, value > 20 OR event_type = 'error' AS r3, "
    "k IS NULL OR value IS NULL AS r4 "
    "FROM (SELECT *, TRY_CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)")

_cmp = ", ".join([f"{_any_failed(_p)} AS overall", f"{_any_failed(_p)} AS set_result"]
                 + [f"{_p[i + 1]} AS r{i}" for i in range(len(_p) - 1)] + [f"CAST(NULL AS BOOLEAN) AS r{len(_p) - 1}"])
ORACLE["distinct_results"] = _w(REC) + (
    f"SELECT overall, set_result, {', '.join(f'r{i}' for i in range(len(_p)))}, count(*) AS n "
    f"FROM (SELECT {_cmp} FROM rec) GROUP BY ALL")

_members = " ".join(f"WHEN grp = {_s(g)} THEN {_s(','.join(ms))}" for g, ms in GROUPS.items())
_nmembers = " ".join(f"WHEN grp = {_s(g)} THEN {len(ms)}" for g, ms in GROUPS.items())
ORACLE["fn_array_case"] = _w(REC, GRP) + (
    f"SELECT key, grp, CASE {_members} ELSE '' END AS members, CASE {_nmembers} ELSE 0 END AS n_members FROM grp")
ORACLE["fn_membership"] = _w(EDGE) + (
    "SELECT key, " + ", ".join(f"{_pred(t, d)} AS r{rid}" for rid, t, d in SQL_SUITE_RULES if t != MISSING)
    + " FROM edge")
ORACLE["fn_missing"] = _w(EDGE) + f"SELECT key, {_missing('id')} AS id_missing, {_missing('code')} AS code_missing FROM edge"
_ep = _preds()
ORACLE["fn_audit_build"] = _w(EDGE) + f"SELECT key, {_audit(_ep, False)} FROM edge"

ORACLE["decision_table_lookup"] = _w(REC, GRP) + (
    f"SELECT key, grp, CASE {_members} END AS members_case, CASE {_members} END AS members_join, "
    + ", ".join(f"CASE WHEN location IN ('US', 'CH', 'MX', 'BR') THEN 'Non UK' ELSE 'none' END AS first_{form}, "
                "CASE location WHEN 'US' THEN 'Non UK,UK & US,Americas' WHEN 'CH' THEN 'Non UK,Europe' "
                f"WHEN 'MX' THEN 'Non UK,Americas' WHEN 'BR' THEN 'Non UK,Americas' ELSE '' END AS all_{form}"
                for form in ("case", "join")) + " FROM grp")
_hits = " ".join(f"WHEN location = {_s(m)} THEN {sum(m in ms for ms in GROUPS.values())}"
                 for m in dict.fromkeys(m for ms in GROUPS.values() for m in ms))
ORACLE["decision_table_conflicts"] = _w(REC) + (
    f"SELECT key, location, CAST(CASE {_hits} ELSE 0 END AS INTEGER) AS hits, "
    f"CASE {_hits} ELSE 0 END <= 1 AS policy_ok, CASE {_hits} ELSE 0 END > 1 AS conflict FROM rec")
ORACLE["decision_rules_join"] = _w(REC) + " UNION ALL ".join(
    f"SELECT key, {rid} AS rule_id FROM rec WHERE {_pred(t, d)}" for rid, t, d in DECISION_SUITE_RULES)
_any_group = "(" + " OR ".join(f"(grp = {_s(g)} AND {_in(g)})" for g in GROUPS) + ")"
_known = f"grp IN ({', '.join(_s(g) for g in GROUPS)})"
ORACLE["decision_functions"] = _w(REC, GRP) + (
    "SELECT key, grp, "
    f"CASE WHEN location IS NULL THEN NULL ELSE COALESCE({_any_group}, false) END AS applicable_sql, "
    f"CASE WHEN location IS NULL OR grp IS NULL OR NOT {_known} THEN NULL ELSE {_any_group} END AS applicable_decision, "
    f"{_missing('key')} AS key_missing FROM grp")

_dp = _preds(DECISION_SUITE_RULES)
_dec_cols = ", ".join(f"{p} AS r{i}" for i, p in enumerate(_dp, 1))
ORACLE["decision_evaluate"] = _w(REC) + f"SELECT key, {_dec_cols} FROM rec"
_missing_rules = {rid: p for (rid, t, _), p in zip(DECISION_SUITE_RULES, _dp) if t == MISSING}
_group_rules = {rid: p for (rid, t, _), p in zip(DECISION_SUITE_RULES, _dp) if t != MISSING}
ORACLE["decision_service"] = _w(REC) + (
    "SELECT key, " + ", ".join(f"{p} AS r{rid}" for rid, p in _missing_rules.items()) + " FROM rec")
ORACLE["decision_all"] = _w(REC) + (
    f"SELECT key, {_dec_cols}, " + ", ".join(f"{p} AS c{i}" for i, p in enumerate(_dp, 1)) + ", "
    + ", ".join(f"{p} AS g{rid}" for rid, p in _group_rules.items()) + ", "
    + ", ".join(f"{p} AS m{rid}" for rid, p in _missing_rules.items()) + " FROM rec")
ORACLE["bind_json"] = _w(GEN) + f"SELECT id, idPrefix, location, {_dec_cols} FROM gen"
ORACLE["bind_struct"] = ORACLE["bind_json"]
ORACLE["bind_fields"] = ORACLE["bind_json"]


def _any_true(preds: list[str]) -> str:
    """array_contains(vector, true): TRUE if any TRUE, else NULL if any NULL, else FALSE."""
    return (f"CASE WHEN {' OR '.join(f'({p}) IS TRUE' for p in preds)} THEN true "
            f"WHEN {' OR '.join(f'({p}) IS NULL' for p in preds)} THEN NULL ELSE false END")


ORACLE["result_struct"] = _w(REC) + (
    "SELECT key, CAST(15 AS INTEGER) AS n_evaluate, CAST(12 AS INTEGER) AS n_membership, CAST(3 AS INTEGER) AS n_missing, "
    f"{_any_true(_dp)} AS any_evaluate, {_any_true(list(_group_rules.values()))} AS any_membership, "
    f"{_any_true(list(_missing_rules.values()))} AS any_missing FROM rec")
ORACLE["result_json"] = _w(REC) + (
    "SELECT key, '{\"evaluate\":[' || concat_ws(',', " + ", ".join(_flag(p) for p in _dp) + ") || ']}' AS result FROM rec")
_unread = "(balance < 0 OR balance >= 1000 AND balance < 2000)"
ORACLE["bad_record_null"] = _w(EDGE) + (
    f"SELECT key, {_unread} AS result_null, "
    + ", ".join(f"CASE WHEN {_unread} THEN NULL ELSE {p} END AS r{i}" for i, p in enumerate(_dp, 1))
    + ", CAST(NULL AS BOOLEAN) AS r16 FROM edge")
ORACLE["typed_input"] = _w(EDGE) + (
    "SELECT key, "
    "CASE WHEN balance < -500 THEN NULL ELSE location END AS location, "
    "CASE WHEN balance < -500 THEN NULL ELSE idPrefix END AS idPrefix, "
    "CAST(CASE WHEN balance < 0 THEN NULL ELSE id END AS VARCHAR) AS id, "
    "CAST(CASE WHEN balance < -500 THEN NULL ELSE page END AS VARCHAR) AS page, "
    "CASE WHEN balance < -500 THEN NULL ELSE department END AS department, "
    "NOT (balance >= -500 AND balance < 0) AS type_ok FROM edge")
ORACLE["stream_rule_vector"] = ORACLE["rule_vector"]

# The orders suite, spelled out per rule: priority groups as IN lists.
_urgent = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
_routine = "o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"
_op = {
    1: f"({_urgent} AND o_orderstatus = 'F')",
    2: f"({_urgent} AND o_orderstatus = 'O')",
    3: f"({_routine} AND o_orderstatus = 'P')",
    4: f"({_routine} AND o_orderstatus = 'F')",
    5: f"({_missing('o_orderpriority')} AND o_orderstatus = 'O')",
    6: "(o_totalprice > 300000 AND o_orderstatus = 'F')",
}
ORACLE["orders_audit"] = (
    f"SELECT o_orderkey AS key, {_any_failed(list(_op.values()))} AS overall, "
    f"{_any_failed([_op[i] for i in (1, 2, 3, 4)])} AS set1, "
    + ", ".join(f"{p} AS r{i}" for i, p in list(_op.items())[:4])
    + f", {_any_failed([_op[5], _op[6]])} AS set2, {_op[5]} AS r5, {_op[6]} AS r6 FROM orders")
ORACLE["orders_rule_counts"] = " UNION ALL ".join(
    f"SELECT {rid} AS rule_id, count(*) FILTER (WHERE {p}) AS n_true, count(*) FILTER (WHERE NOT {p}) AS n_false, "
    f"count(*) FILTER (WHERE {p} IS NULL) AS n_null FROM orders" for rid, p in _op.items())
ORACLE["orders_rule_hits"] = " UNION ALL ".join(
    f"SELECT o_orderkey, {rid} AS rule_id FROM orders WHERE {p}" for rid, p in _op.items() if rid < 6)

_chain = """
a AS (SELECT *, department IN ('sales', 'hr') AS e1, id % 3 = 0 AS e2, location IN ('US', 'CH', 'MX', 'BR') AS e5 FROM edge),
b AS (SELECT *, e1 AND e2 AS e3 FROM a), d AS (SELECT *, NOT e3 OR e5 AS e4 FROM b),
f AS (SELECT *, e4 AND NOT e2 AND page < 9 AS e6 FROM d)"""
_e = [f"e{i}" for i in range(1, 7)]
ORACLE["entry_chain"] = _w(EDGE).rstrip() + f", {_chain} SELECT key, {_any_failed(_e)} AS any_failed, " + ", ".join(
    f"e{i} AS r{i}, e{i} AS c{i}" for i in range(1, 7)) + " FROM f"
_nested = ("location = 'US' AND key % 2 = 0", "idPrefix LIKE 'A%'", "page > 10 OR location IS NULL",
           "CASE WHEN location IS NULL THEN NULL ELSE location IN ('US', 'CH') END")
ORACLE["nested_paths"] = _w(EDGE) + "SELECT key, " + ", ".join(
    f"{p} AS {n}{i}" for n in "fsj" for i, p in enumerate(_nested, 1)) + " FROM edge"
_number = "CASE WHEN balance < 0 THEN NULL ELSE key % 1000 END"
_failing = (f"{_number} > 700", f"{_number} > 700", f"{_number} > 700",
            "CASE WHEN page <> 0 THEN 100.0 / page > 10 END", "CASE page WHEN 0 THEN true WHEN 1 THEN false END",
            f"{_number} > 500", f"{_number} > 700", "CASE WHEN 2147483640 + page <= 2147483647 THEN true END",
            "CASE WHEN page <> 3 THEN page > 1 END", "page % 2 = 0")
ORACLE["rule_errors_null"] = _w(EDGE) + "SELECT key, " + ", ".join(
    f"{p} AS r{i}" for i, p in enumerate(_failing, 1)) + ", balance < 0 AS no_result, " + ", ".join(
    f"{_number} > 700 AS w{i}" for i in (1, 2, 3)) + " FROM edge"
ORACLE["rules_frame_hits"] = """
WITH u AS (SELECT o_orderdate::DATE AS day, o_orderstatus AS status, o_totalprice AS price, o_orderkey AS k
           FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, date_diff('day', DATE '1990-01-01', day)::INTEGER AS rule_id
FROM orders JOIN (SELECT DISTINCT day, status FROM u) ON o_orderdate::DATE = day AND o_orderstatus = status
UNION ALL SELECT o_orderkey, (-k)::INTEGER FROM orders JOIN u ON o_totalprice = price AND k % 10 = 0"""
_grp = _case("code", SEGMENT_GROUP)
_known_grp = f"{_grp} IN ({', '.join(_s(g) for g in GROUPS)})"
_member = "(" + " OR ".join(f"({_grp} = {_s(g)} AND {_in(g)})" for g in GROUPS) + ")"
_sql_member = f"CASE WHEN location IS NULL THEN NULL ELSE COALESCE({_member}, false) END"
_model_member = f"CASE WHEN location IS NULL OR {_grp} IS NULL OR NOT {_known_grp} THEN NULL ELSE {_member} END"
_library = (_sql_member, _model_member, f"(({_missing('id')} OR {_model_member}) AND id % 2 = 0)", _missing("id"), "id > 100")
ORACLE["imported_library"] = _w(EDGE) + "SELECT key, " + ", ".join(
    f"{p} AS r{i}" for i, p in enumerate(_library, 1)) + " FROM edge"
_uses = (("dq is applicable for", 5, 1, 1, (1,)), ("isMissing", 6, 1, 1, (4,)),
         ("model.dq is applicable for", 5, 1, 1, (2, 3)), ("model.isMissing", 6, 1, 0, (3,)), ("model.either", 7, 2, 1, (3,)))
ORACLE["function_usage"] = _w(EDGE) + " UNION ALL ".join(
    f"SELECT {_s(name)} AS function_name, {fid} AS function_id, {version} AS function_version, {len(rules)}::BIGINT AS n_rules, "
    f"{direct}::BIGINT AS n_direct, (" + " + ".join(f"count(*) FILTER (WHERE {_library[r - 1]})" for r in rules) + ") AS n_true FROM edge"
    for name, fid, version, direct, rules in _uses)
ORACLE["typed_loss"] = """
SELECT o_orderkey AS key, true AS price_ok, o_orderkey % 3 <> 0 AS stamp_ok,
       o_orderkey % 2 = 0 AND (o_orderkey < 16777216 OR o_orderkey % 4 = 0) AS big_ok, o_orderkey % 2 <> 0 AS status_ok,
       o_totalprice = floor(o_totalprice) AS total_ok, o_orderkey % 2 = 0 AS moment_ok,
       o_orderkey % 2 = 0 AND (o_orderkey < 16777216 OR o_orderkey % 4 = 0) AS whole_ok
FROM orders"""
