"""The table readings of ``provenant.sources.testdata`` in SQL, put before a check as common tables."""

from __future__ import annotations

import re

MODELS: dict[str, str] = {
    "work": """
  SELECT 'w'||o_orderkey AS record_id, o_orderkey AS seq, o_orderpriority AS kind,
         'cd /c/'||o_custkey||' && tool'||o_orderstatus||' state.csv --level='||substr(o_orderpriority,1,1) AS cmd,
         'env-'||lower(o_orderstatus) AS environment, o_orderpriority='4-NOT SPECIFIED' AS declared,
         o_orderdate AS at, 'c'||o_custkey AS owner,
         CASE o_orderstatus WHEN 'P' THEN ['own','partner'] WHEN 'O' THEN ['partner'] ELSE ['own'] END AS registries
  FROM orders""",
    "states": """
  SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n
  FROM orders""",
    "work_file": """
  SELECT 'w'||o_orderkey AS record_id, 'out' AS role, '/c/'||o_custkey||'/state.csv' AS path,
         'cust:'||o_custkey||':'||n AS hash FROM states
  UNION ALL
  SELECT 'w'||o_orderkey, 'in', '/c/'||o_custkey||'/state.csv', 'cust:'||o_custkey||':'||(n-1) FROM states WHERE n>1
  UNION ALL
  SELECT DISTINCT 'w'||l_orderkey, 'in', '/p/'||l_partkey||'.csv', 'part:'||l_partkey FROM lineitem
  UNION ALL
  SELECT DISTINCT 'w'||l_orderkey, 'out', '/s/'||l_suppkey, 'supp:'||l_suppkey FROM lineitem""",
    "signature": """
  SELECT 'w'||o_orderkey AS record_id, 0 AS pos, 'n'||c_nationkey AS declared,
         CASE WHEN o_orderstatus<>'P' THEN 'n'||c_nationkey END AS keyid
  FROM orders JOIN customer ON o_custkey=c_custkey
  UNION ALL
  SELECT 'w'||o_orderkey, 1, 'n'||((c_nationkey+7)%25), 'n'||((c_nationkey+7)%25)
  FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderpriority IN ('1-URGENT','2-HIGH')""",
    "trust_key": """
  SELECT 'n'||n_nationkey AS keyid, lower(r_name) AS tier, n_name AS name
  FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'AFRICA'""",
    "verified": """
  SELECT record_id, pos, keyid, tier, name FROM signature JOIN trust_key USING (keyid)""",
    "claim": """
  SELECT 'e'||event_id AS claim_id, event_id AS seq, 'part:'||k AS subject, event_type AS predicate,
         'n'||(user_id%25) AS keyid, ts AS at,
         'e'||first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scope,
         'e'||lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS genesis,
         'L'||least(CAST(floor(value/10) AS BIGINT),2) AS level, value,
         'e'||lag(event_id) OVER (PARTITION BY user_id, event_type, k ORDER BY ts, event_id) AS replaces,
         'u'||user_id AS person,
         CASE WHEN event_type='purchase' THEN ['own','partner']
              WHEN event_type IN ('error','signup') THEN ['partner'] ELSE ['own'] END AS registries
  FROM (SELECT *, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)""",
    "trusted_claim": """
  SELECT c.*, t.tier, t.name FROM claim c JOIN trust_key t USING (keyid)""",
    "claim_position": """
  SELECT claim_id, row_number() OVER (PARTITION BY scope ORDER BY c.at, seq) - 1 AS position FROM claim c""",
    "turn_claim": """
  SELECT 'c'||conv_id||':'||turn AS claim_id, 'c'||conv_id||':0' AS scope,
         CASE WHEN turn>0 THEN 'c'||conv_id||':'||(turn-1) END AS prev, turn=0 AS genesis, role AS keyid,
         turn AS seq, text FROM conversations""",
    "label_claim": """
  SELECT 'l'||doc_id AS claim_id, 'doc:'||doc_id AS subject, CAST(quality AS BIGINT) AS quality,
         CAST(toxic AS BIGINT) AS toxic FROM labels""",
    "trace_source": """
  SELECT *, CAST(json_extract(props,'$.k') AS BIGINT) AS k,
         sha256(CAST(CAST(json_extract(props,'$.k') AS BIGINT) AS VARCHAR)||':'||CAST(floor(value/8) AS BIGINT)) AS sha
  FROM events""",
    "trace_event": """
  SELECT 's'||user_id AS session, event_id*2 AS ord, epoch_us(ts)*1000 AS ts_ns, CASE event_type WHEN 'error' THEN 1 ELSE k+10 END AS pid, 1 AS ppid,
         CASE event_type WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'open'
              WHEN 'click' THEN CASE WHEN value<5 THEN 'connect' ELSE 'exec' END
              WHEN 'signup' THEN CASE WHEN value>=12 THEN 'rename' ELSE 'unlink' END ELSE 'TASK' END AS op,
         CASE event_type WHEN 'view' THEN 'r' WHEN 'purchase' THEN 'w'
              WHEN 'click' THEN CASE WHEN value<5 THEN '-' ELSE 'q' END
              WHEN 'signup' THEN '-' ELSE CASE WHEN value<20 THEN 'ok' ELSE 'err' END END AS mode,
         CASE event_type WHEN 'view' THEN '/proj/'||k||'.csv' WHEN 'purchase' THEN '/proj/'||k||'.csv'
              WHEN 'click' THEN CASE WHEN value<5 THEN 'inet:10.0.0.'||k||':443' ELSE '/proj' END
              WHEN 'signup' THEN CASE WHEN value>=12 THEN '/proj/'||k||'.old.csv' ELSE '/proj/'||k||'.csv' END
              ELSE 't'||event_id END AS path,
         epoch_us(ts)*1000 AS mtime_ns,
         CASE event_type WHEN 'view' THEN 'sha256='||sha WHEN 'purchase' THEN 'trunc=1'
              WHEN 'click' THEN CASE WHEN value<5 THEN 'class=remote;rc=0' ELSE '/bin/tool'||k||' -i /proj/'||k||'.csv' END
              WHEN 'signup' THEN CASE WHEN value>=12 THEN '/proj/'||k||'.csv' ELSE '' END
              ELSE 'expr '||k END AS extra,
         CASE WHEN event_type='view' THEN sha END AS sha
  FROM trace_source
  UNION ALL
  SELECT 's'||user_id, event_id*2+1, epoch_us(ts)*1000+1, k+10, 1, 'closew', '-', '/proj/'||k||'.csv',
         epoch_us(ts)*1000, 'sha256='||sha, sha
  FROM trace_source WHERE event_type='purchase'""",
    "manifest": """
  SELECT '/d/'||source||'/'||lang||'/'||doc_id AS path, sha256(text) AS sha, n_chars AS size, source, lang,
         doc_id AS ino FROM documents""",
}


def with_models(body: str) -> str:
    """``body`` with the models it names, and those they name, before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in MODELS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    tables = ",\n".join(f"{name} AS ({MODELS[name]})" for name in needed)
    text = body.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s+", text, re.I)
    plain = re.match(r"WITH\s+", text, re.I)
    if recursive:
        return f"WITH RECURSIVE {tables},\n{text[recursive.end():]}"
    if plain:
        return f"WITH {tables},\n{text[plain.end():]}"
    return f"WITH {tables}\n{text}"
