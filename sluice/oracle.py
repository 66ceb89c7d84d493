"""DuckDB oracle SQL for every registered query.

``CTES`` holds the fixture views (FIXTURES.md) as DuckDB common table expressions over the
pre-registered tables; ``sql(body, *deps)`` prefixes a query body with the CTEs it needs
(dependencies resolved transitively, in definition order).
"""

from __future__ import annotations

NL = "chr(10)"

# name -> (definition, dependencies)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, deps)


def sql(body: str, *deps: str, overrides: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs; ``overrides`` replaces CTE bodies by name
    (e.g. a different seed list)."""
    overrides = overrides or {}
    needed: list[str] = []

    def visit(n: str) -> None:
        if n in needed:
            return
        for d in CTES[n][1]:
            visit(d)
        needed.append(n)

    for d in deps:
        visit(d)
    order = [n for n in CTES if n in needed]
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{overrides.get(n, CTES[n][0])}\n)" for n in order) + "\n" + body


# ---------------------------------------------------------------- fixture views
cte("fbase", f"""
SELECT d.doc_id AS func_id, d.text AS code,
  (CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic=1 OR l.quality=0 THEN 1 ELSE 0 END
        WHEN d.doc_id%2=0 THEN 1 ELSE 0 END)::INTEGER AS label,
  (CASE WHEN l.doc_id IS NULL AND d.doc_id%2=0 THEN 1 ELSE 0 END)::INTEGER AS latent,
  CASE WHEN l.doc_id IS NULL AND d.doc_id%2=0 THEN CASE WHEN d.doc_id%3=0 THEN 'b' ELSE 'v' END END AS method,
  CASE WHEN l.doc_id IS NULL AND d.doc_id%2=0 THEN d.doc_id-d.doc_id%10 ELSE d.doc_id END AS vfc,
  string_split(d.text, {NL}) AS ls
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""")

cte("functions", """
SELECT func_id, code, label, latent, method, vfc,
  CASE WHEN label=1 THEN array_to_string(list_transform(
      list_filter(range(1, len(ls)+1), lambda i: length(ls[i])>0 AND length(ls[i])%5=0),
      lambda i: ls[i]), '/~/') END AS flaw_line,
  CASE WHEN label=1 THEN array_to_string(list_transform(
      list_filter(range(1, len(ls)+1), lambda i: length(ls[i])>0 AND length(ls[i])%5=0),
      lambda i: i::VARCHAR), ',') END AS flaw_line_index
FROM fbase""", "fbase")

cte("predictions", """
SELECT *, (prob > 0.5)::INTEGER AS y_pred FROM (
  SELECT *, 0.6::DOUBLE * (('0x'||substr(sha256(code),1,8))::BIGINT / 4294967296::DOUBLE)
            + 0.4::DOUBLE * label::DOUBLE AS prob
  FROM functions)""", "functions")

cte("flines", f"""
SELECT func_id, f_label, (generate_subscripts(nb, 1) - 1)::INTEGER AS line_idx,
       unnest(nb)::INTEGER AS line_no, ls
FROM (SELECT func_id, label AS f_label, string_split(code, {NL}) AS ls,
             list_filter(range(1, len(string_split(code, {NL}))+1),
                         lambda i: length(string_split(code, {NL})[i])>0) AS nb
      FROM functions WHERE latent=0)""", "functions")

cte("line_scores", """
SELECT func_id, line_idx,
  ((('0x'||substr(sha256(concat_ws('|', func_id, line_no)),1,6))::BIGINT % 1000))::DOUBLE AS score,
  (f_label=1 AND length(ls[line_no])%5=0)::INTEGER AS label
FROM flines""", "flines")

# ---------------------------------------------------------------- split builder
cte("seeds", "SELECT 10000::BIGINT AS seed")
SEEDS10 = "SELECT unnest([10000,20000,30000,40000,50000,60000,70000,80000,90000,100000])::BIGINT AS seed"

cte("hashed", """
SELECT func_id, label, latent, method, vfc, sha256(code) AS hash_code FROM functions""", "functions")

cte("sp_base", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY hash_code
                               ORDER BY CASE WHEN label=1 THEN 0 ELSE 1 END, func_id) AS rn
  FROM hashed WHERE latent=0 AND label IN (0,1)) WHERE rn=1""", "hashed")

cte("sp_lat", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY hash_code ORDER BY func_id) AS rn
  FROM hashed WHERE label=1 AND latent=1 AND method='v') WHERE rn=1""", "hashed")

# latent rows that augment training (P2 overrides this with the 'latest' table)
cte("sp_lat_aug", "SELECT * FROM sp_lat", "sp_lat")

cte("sp_assigned", """
SELECT *, CASE WHEN rk <= floor(n*0.8::DOUBLE) THEN 'train'
               WHEN rk <= floor(n*0.8::DOUBLE) + floor((n - floor(n*0.8::DOUBLE))*0.5::DOUBLE) THEN 'val'
               ELSE 'test' END AS split
FROM (SELECT s.seed, b.*,
             row_number() OVER (PARTITION BY s.seed ORDER BY sha256(s.seed::VARCHAR||'|'||b.hash_code), b.hash_code) AS rk,
             count(*) OVER (PARTITION BY s.seed) AS n
      FROM seeds s, sp_base b)""", "seeds", "sp_base")

cte("sp_train", "SELECT * FROM sp_assigned WHERE split='train'", "sp_assigned")

cte("sp_held", """
SELECT * FROM sp_assigned
WHERE split<>'train' AND NOT (label IN (0,1) AND hash_code IN (SELECT hash_code FROM sp_lat))""",
    "sp_assigned", "sp_lat")

cte("sp_aug", """
SELECT * EXCLUDE (rn, prio) FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, hash_code ORDER BY prio, func_id) AS rn FROM (
    SELECT s.seed, l.func_id, l.hash_code, l.label, l.latent, l.method, l.vfc, 0 AS prio
    FROM seeds s, sp_lat_aug l
    WHERE EXISTS (SELECT 1 FROM sp_train t WHERE t.seed=s.seed AND t.func_id IS NOT DISTINCT FROM l.vfc)
    UNION ALL
    SELECT seed, func_id, hash_code, label, latent, method, vfc, 1 FROM sp_train)) WHERE rn=1""",
    "seeds", "sp_lat_aug", "sp_train")

cte("splits", """
SELECT seed, split, func_id, hash_code, label, latent, method, vfc FROM sp_train
UNION ALL SELECT seed, split, func_id, hash_code, label, latent, method, vfc FROM sp_held
UNION ALL SELECT seed, 'train_latent', func_id, hash_code, label, latent, method, vfc FROM sp_aug""",
    "sp_train", "sp_held", "sp_aug")
