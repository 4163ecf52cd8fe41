"""DuckDB SQL for the operators that SQL can express."""

from phonelens.llm import licenses, quality, sharding

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sharding_sql(n_shards: int) -> str:
    """Descends the tree by the same draws: a node's arrival is -ln(u) / weight."""
    def arrival(node):
        u = f"(CAST('0x' || substr(md5(key || '/{node.name}'), 1, {sharding.HEX_DIGITS}) AS BIGINT) + 1.0)"
        return f"(-ln({u} / {sharding.RESOLUTION!r}) / {node.weight!r})"

    def place(node):
        live = node.children
        if not live:
            return str(node.shard)
        if len(live) == 1:
            return place(live[0])
        draws = "list_value(" + ", ".join(arrival(c) for c in live) + ")"
        cases = " ".join(f"WHEN {i + 1} THEN {place(c)}" for i, c in enumerate(live))
        return f"(CASE list_position({draws}, list_min({draws})) {cases} END)"

    root = sharding.tree(n_shards)
    bigger = sharding.grown(root, n_shards)
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    table = f"list_transform(range(0, 256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {step}))"
    hexed = "hex(encode(coalesce(text, '')))"
    octets = f"list_transform(range(0, length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    return f"""
WITH t AS MATERIALIZED (SELECT {table} AS crc),
b AS MATERIALIZED (SELECT doc_id, text, list_prepend(4294967295, {octets.replace(hexed, 'h')}) AS bytes
      FROM (SELECT doc_id, text, {hexed} AS h FROM documents)),
d AS (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
             xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) AS text_crc32
      FROM b, t),
p AS (SELECT doc_id, text_crc32, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size,
             CAST({place(root)} AS INTEGER) AS shard, CAST({place(bigger)} AS INTEGER) AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM p"""


def quality_sql() -> str:
    stops = ", ".join(_sql(v) for v in sorted({v for x in quality.STOP_WORDS for v in (x, x.capitalize())}))
    rules = []
    for r in quality.DEFAULT_RULES:
        parts = [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
        rules.append(f"coalesce(({' AND '.join(parts)}) OR n_words < {r.from_words}, true)")
    blank = r"regexp_matches(x, '[^\x20\x09-\x0D]')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {blank}) AS lines FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS gram FROM
      (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
       len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
       len(list_filter(lines, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', '•'))) AS n_bullet_lines,
       len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines
      FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
q AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(word_chars, 0) AS symbol_ratio,
       n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_stop_words / nullif(n_words, 0) AS stop_word_ratio,
       n_bullet_lines / nullif(n_lines, 0) AS bullet_line_ratio,
       n_ellipsis_lines / nullif(n_lines, 0) AS ellipsis_line_ratio,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(rules)} AS kept FROM q"""


def decontaminate_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all(coalesce({low.format('text')}, ''), '[^\x20\x09-\x0D]+')"
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, list_slice(w, i, i + least(len(w), 5) - 1) AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
d AS (SELECT doc_id, {words} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, list_slice(w, i, i + k - 1) AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT ds.doc_id, bs.item_id, count(*) AS c FROM ds JOIN bs ON ds.k = bs.k AND ds.s = bs.s GROUP BY 1, 2)
SELECT h.doc_id, h.item_id, bn.n AS n_item_shingles, h.c AS n_shared
FROM h JOIN bn ON bn.item_id = h.item_id WHERE h.c >= 0.8 * bn.n"""


def licenses_sql() -> str:
    rows, text = [], "translate(coalesce(text, ''), {}, {})".format(
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '.,;:()\"'''",
        "'abcdefghijklmnopqrstuvwxyz     '")
    for name, t in licenses.TEMPLATES.items():
        w = licenses.template_words(t)
        shingles = sorted({" ".join(w[i: i + 5]) for i in range(len(w) - 4)})
        window, stride, _ = licenses.grid(licenses.size_class(len(shingles)))
        rows += [f"({_sql(name)}, {len(shingles)}, {window}, {stride}, {_sql(s)})" for s in shingles]
    return f"""
WITH t(license, n, win, stride, s) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, list_filter(string_split({text}, ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS i, array_to_string(list_slice(w, i, i + 4), ' ') AS s, len(w) - 4 AS size
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT g.doc_id, t.license, t.n, t.win, t.stride, g.i, g.s FROM g JOIN t ON t.s = g.s),
v AS (SELECT doc_id, license, n, win, stride, i, s, unnest(range(
        CAST(greatest(0, ceil((i - win + 1) / stride)) AS BIGINT), CAST(floor(i / stride) AS BIGINT) + 1)) AS k FROM h),
c AS (SELECT doc_id, license, n, k * stride AS start, count(DISTINCT s) AS n_shared FROM v GROUP BY ALL),
f AS (SELECT * FROM c WHERE n_shared >= 0.8 * n),
b AS (SELECT doc_id, license, n, max(n_shared) AS n_shared FROM f GROUP BY ALL)
SELECT b.doc_id, b.license, CAST(b.n AS BIGINT) AS n_template, b.n_shared, min(f.start) AS first_word
FROM b JOIN f ON f.doc_id = b.doc_id AND f.license = b.license AND f.n_shared = b.n_shared GROUP BY ALL"""


def _lower_words(text: str = "text") -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all(coalesce({low}, ''), '[^\x20\x09-\x0D]+')"


def jaccard_sql(n: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_lower_words()} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), {n}) - 1) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT p.a, p.b FROM
      (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
      JOIN c ca ON ca.doc_id = p.a JOIN c cb ON cb.doc_id = p.b
      WHERE 100 * p.o >= {percent} * (ca.n + cb.n - p.o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = d.doc_id"""


def lines_sql(width: int, percent: int) -> str:
    """Lines are numbered from 0; their classes close over similar pairs."""
    trimmed = r"trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, x AS line FROM (
      SELECT doc_id, i, {trimmed} AS x FROM (SELECT doc_id, i, ls[i] AS x FROM (
        SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))) WHERE x <> ''),
u AS MATERIALIZED (SELECT line, row_number() OVER () AS id, place AS at_ FROM (
      SELECT line, min(struct_pack(d := doc_id, n := line_no)) AS place FROM o GROUP BY 1)),
s AS MATERIALIZED (SELECT DISTINCT id, substr(line, i, {width}) AS g FROM (
      SELECT id, line, unnest(range(1, length(line) - {width - 2})) AS i FROM u WHERE length(line) > {width})),
c AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT p.a, p.b FROM (
      SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2) p
      JOIN c ca ON ca.id = p.a JOIN c cb ON cb.id = p.b WHERE 100 * p.k >= {percent} * (ca.n + cb.n - p.k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
f AS (SELECT u.id, u.line, least(u.at_, coalesce(min(v.at_), u.at_)) AS first FROM u LEFT JOIN r ON r.a = u.id
      LEFT JOIN u v ON v.id = r.b GROUP BY u.id, u.line, u.at_)
SELECT o.doc_id, o.line_no, f.first.d AS class_doc_id, f.first.n AS class_line_no,
       o.doc_id = f.first.d AND o.line_no = f.first.n AS kept FROM o JOIN f ON f.line = o.line"""


def substring_sql(n: int) -> str:
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS s FROM
      (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})),
e AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM g) WHERE m < doc_id),
x AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM e, (SELECT unnest(range(0, {n})) AS k) GROUP BY 1),
y AS (SELECT d.doc_id, len(d.w) AS n, coalesce(len(x.gone), 0) AS r, d.w, x.gone FROM d LEFT JOIN x ON x.doc_id = d.doc_id),
k AS (SELECT y.doc_id, string_agg(p.v, ' ' ORDER BY p.i) AS kept FROM y,
      LATERAL (SELECT unnest(y.w) AS v, unnest(range(1, len(y.w) + 1)) AS i) p
      WHERE y.gone IS NULL OR NOT list_contains(y.gone, p.i) GROUP BY 1)
SELECT y.doc_id, CAST(y.n AS BIGINT) AS n_words, CAST(y.r AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256 FROM y LEFT JOIN k ON k.doc_id = y.doc_id"""


def crc32_sql(text: str) -> tuple[str, str]:
    """(table, value): the unsigned CRC-32 of a text's UTF-8 bytes; ``value``
    reads the column ``crc`` that selecting ``table`` gives."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    table = f"list_transform(range(0, 256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {step}))"
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return table, (f"xor(list_reduce(list_prepend(4294967295, {octets}), "
                   "lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295)")


def merkle_sql() -> str:
    table, crc = crc32_sql("CAST(doc_id AS VARCHAR)")

    def part(x):
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"

    def digest(chars):
        return "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", chars, "text")) + ")"

    def tree(out, rows):  # every level of each tree
        return f"""{out} AS (
  SELECT tree, 0 AS lvl, i, h, w FROM {rows}
  UNION ALL
  SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(w) + 1) // 2
  FROM {out} WHERE w > 1 GROUP BY tree, lvl, i // 2)"""

    def climb(out, rows, nodes):  # cur: the digest on the way, sib: siblings so far
        return f"""{out} AS (
  SELECT rid, tree, pos, w, 0 AS lvl, cur, sib FROM {rows}
  UNION ALL
  SELECT c.rid, c.tree, c.pos // 2, (c.w + 1) // 2, c.lvl + 1,
         sha256(CASE WHEN n.h IS NULL THEN c.cur WHEN c.pos % 2 = 1 THEN n.h || c.cur ELSE c.cur || n.h END),
         c.sib || coalesce(n.h, '')
  FROM {out} c LEFT JOIN {nodes} n ON n.tree = c.tree AND n.lvl = c.lvl AND n.i = xor(c.pos, 1) WHERE c.w > 1)"""

    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {table} AS crc),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || lang, '0') AS tree, {digest("n_chars")} AS leaf,
       CASE WHEN doc_id IS NOT NULL AND ({crc}) % 7 = 0 THEN {digest("(n_chars + 1)")} ELSE {digest("n_chars")} END AS cur
     FROM documents, t),
a AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
       count(*) OVER (PARTITION BY tree) AS w FROM d),
{tree("up", "a")},
s AS MATERIALIZED (SELECT tree AS lang, '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS w
     FROM up WHERE w = 1),
{tree("above", "s")},
{climb("way", "(SELECT rid, tree, i AS pos, w, cur, '' AS sib FROM a)", "up")},
{climb("rest", "(SELECT rid, s.tree, s.i AS pos, s.w, cur, sib FROM way JOIN s ON s.lang = way.tree WHERE way.w = 1)", "above")}
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(sib) AS proof_sha256, rest.cur AS folded_root, rest.cur = r.h AS verified
FROM a JOIN rest ON rest.rid = a.rid AND rest.w = 1 JOIN s ON s.lang = a.tree, (SELECT h FROM above WHERE w = 1) r"""


def spelling_sql(noise: int, min_length: int = 7, min_count: int = 2, factor: int = 10) -> str:
    """Near words by brute force over what one left-out code point leaves."""
    table, crc = crc32_sql("named")
    at = "CAST(h % length(run) AS INTEGER)"
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {table} AS crc),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS MATERIALIZED (SELECT run, named, c, {crc} AS h FROM
      (SELECT run, doc_id || ':' || run AS named, count(*) AS c FROM r WHERE length(run) >= {min_length} GROUP BY ALL), t),
v AS (SELECT c, CASE WHEN h % {noise} = 0 THEN substr(run, 1, {at}) || substr(run, {at} + 2) ELSE run END AS word FROM u),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM v WHERE length(word) >= {min_length} GROUP BY 1 HAVING sum(c) >= {min_count}),
p AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM
      (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION SELECT p.word, w.word, w.n FROM p JOIN w ON w.word = p.rest
   UNION SELECT w.word, p.word, p.n FROM p JOIN w ON w.word = p.rest),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, encode(other))) AS other FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {factor} * w.n THEN other END AS form,
        CASE WHEN top >= {factor} * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, form AS next FROM f
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL"""
