"""SQL that another engine can run over the same tables, where SQL expresses the operator."""

from __future__ import annotations


def clustering_sql(components: int = 64, scale: int = 1024, centroids: int = 8, rounds: int = 10) -> str:
    """Whole-number clustering with every distance measured, round by round."""
    parts = [f"""
    kept AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS vals FROM embeddings
      WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components}),
    x AS MATERIALIZED (SELECT row, unnest(range({components})) AS i, unnest(vals) AS v FROM kept),
    c0 AS MATERIALIZED (SELECT k, unnest(range({components})) AS i, unnest(vals) AS v FROM (
      SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, vals) - 1 AS k, vals FROM kept) WHERE k < {centroids})"""]
    for r in range(rounds + 1):
        parts.append(f"""
    a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, k := k)) AS best FROM (
      SELECT x.row, c.k, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c USING (i) GROUP BY x.row, c.k) GROUP BY row)""")
        if r < rounds:
            parts.append(f"""
    m{r} AS MATERIALIZED (SELECT a.best.k AS k, x.i, sum(x.v) AS s, count(*) AS n FROM x JOIN a{r} a USING (row) GROUP BY a.best.k, x.i),
    c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.v ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS v
      FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.i = m.i)""")
    last = f"a{rounds}"
    return f"""WITH {",".join(parts)},
    prints AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS print FROM c{rounds} GROUP BY k)
    SELECT kept.vec_id, CAST(a.best.k AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
      CAST(sum(a.best.d) OVER (PARTITION BY a.best.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, prints.print AS centroid_sha256
    FROM kept JOIN {last} a USING (row) JOIN prints ON prints.k = a.best.k"""


def repair_sql() -> str:
    """Damage, faults, and the cheapest repair by a recursion over the rows of all conversations at once."""
    table = "SELECT n, n AS c FROM range(256) r(n)"
    for _ in range(8):
        table = f"SELECT n, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM ({table})"
    state = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"

    def then(one: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {one} IS NULL THEN NULL ELSE struct_pack(c := {one}.c + {cost}, a := {one}.a || {letter}, o := {one}.o || {line}) END"

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def output(one: str, letter: str, role: str) -> str:
        keep, blocked = f"initial = '{letter}'", "fault IN ('b', 'd')"
        cost = f"(CASE WHEN {keep} THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END)"
        way = then(one, cost, f"CASE WHEN {keep} THEN 'K' ELSE 'R' END", f"chr(10) || CASE WHEN {keep} THEN role ELSE '{role}' END || ':' || text")
        return f"CASE WHEN {blocked} THEN NULL ELSE {way} END"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    spoken = then("s0", "CASE WHEN fault = 't' THEN 3 ELSE 0 END", "'K'", "chr(10) || role || ':' || text")
    filled = f"""SELECT *, {best("s3", then("b2", "3", "'I'", assistant))} AS b3 FROM (
          SELECT *, {best("s2", then("s0", "3", "'I'", user), then("s1", "3", "'I'", user), then("s3", "3", "'I'", user))} AS b2 FROM"""
    return f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM ({table})),
    told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    drawn AS (SELECT told.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda acc, b: xor(acc >> 8, t[xor(acc & 255, b) + 1]))) % 20 AS damage FROM told, crc),
    bent AS (SELECT conv, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
      CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE damage <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, left(role, 1) AS initial FROM bent),
    rows AS MATERIALIZED (SELECT conv, turn, role, text, n, initial,
      lag(initial) OVER (PARTITION BY conv ORDER BY n) || initial AS pair,
      CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 'd'
        WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
    counts AS (SELECT conv, count(*) AS total, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
      count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM rows GROUP BY conv),
    dp AS (
      SELECT conv, CAST(0 AS BIGINT) AS n, CAST(struct_pack(c := 0, a := '', o := '') AS {state}) AS s0, CAST(NULL AS {state}) AS s1, CAST(NULL AS {state}) AS s2,
        CAST(NULL AS {state}) AS s3 FROM counts
      UNION ALL
      SELECT conv, n + 1, {then("s0", "4", "'D'")}, {best(then("s1", "4", "'D'"), f"CASE WHEN fault IN ('b', 'd') OR initial <> 's' THEN NULL ELSE {spoken} END")},
        {best(then("b2", "4", "'D'"), output("s0", "u", "user"), output("s1", "u", "user"), output("b3", "u", "user"))},
        {best(then("b3", "4", "'D'"), output("b2", "a", "assistant"))} FROM (
        {filled} (SELECT dp.*, r.role, r.text, r.initial, r.fault FROM dp JOIN rows r ON r.conv = dp.conv AND r.n = dp.n + 1)))),
    ended AS (SELECT conv, {best("s0", "b3")} AS e FROM ({filled} (SELECT dp.* FROM dp JOIN counts c ON c.conv = dp.conv AND c.total = dp.n))))
    SELECT t.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
      CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost,
      coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.o, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, conv FROM told) t LEFT JOIN counts ON counts.conv = t.conv LEFT JOIN ended ON ended.conv = t.conv"""


CHECKS: dict[str, str] = {"op11_structure_repair": repair_sql(), "op13_filtered_clustering": clustering_sql()}
