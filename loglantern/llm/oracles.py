"""DuckDB SQL for the operators whose results SQL can express, written on its own.

Patterns, weights and names that results depend on come from the operators; the way to the
result is another one: plain joins of all rows, closed forms and recursion.
"""

from __future__ import annotations

from loglantern.llm import chat, mixing, url_reputation, warc


def q(text: str) -> str:
    """A string literal, signs below blank and beyond ASCII as chr()."""
    parts = ["'" + "".join("''" if c == "'" else c for c in text) + "'"] if text.isprintable() else []
    if not parts:
        for c in text:
            parts.append(f"chr({ord(c)})" if not c.isprintable() else "'" + ("''" if c == "'" else c) + "'")
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


# --- url reputation ----------------------------------------------------------------------
def _rho(units: str, mean: str) -> str:
    return f"""least(greatest(coalesce(
      sum((good - n * {mean}) * (good - n * {mean}) / (n * {mean} * (1 - {mean})) - 1) / nullif(sum(n - 1), 0),
      {url_reputation.LEAST_CORRELATION}), {url_reputation.LEAST_CORRELATION}), {url_reputation.MOST_CORRELATION})"""


def _level(name: str, units: str, mean: str) -> str:
    """A step of shrinkage: units with n, good and their parent's rate become units with their own."""
    return f"""
{name}_rho AS (SELECT coalesce((SELECT 1 / ({_rho(units, mean)}) - 1 FROM {units} WHERE n > 0), 0) AS strength),
{name} AS (SELECT u.*, strength, (strength * {mean} + good) / (strength + n) AS {name}_rate FROM {units} u, {name}_rho)"""


def url_reputation_sql(rules: list[tuple[str, str]]) -> str:
    fits = []
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[0]), reverse=False):
        top, _, below = text.partition("/")
        test = f"(host = '{top}' OR ends_with(host, '.{top}')) AND starts_with(path, '/{below}')"
        fits.append((test, text, kind))
    rule = "CASE " + " ".join(f"WHEN {t} THEN '{text}'" for t, text, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {t} THEN '{kind}'" for t, _, kind in fits)
    doubles = ", ".join(f"'{s}'" for s in url_reputation.DOUBLE_SUFFIXES)
    return f"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcomes AS (SELECT host, quality FROM parsed JOIN labels
  ON doc_id = TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})', 1) AS BIGINT)),
names AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\\.$', '') AS name FROM parsed),
parts AS (SELECT host, name, string_split(name, '.') AS p,
  regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$|[\\[\\]:]') AS address FROM names),
placed AS (SELECT host, CASE WHEN address THEN name
      WHEN array_to_string(p[-2:], '.') IN ({doubles}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
    CASE WHEN address THEN name WHEN array_to_string(p[-2:], '.') IN ({doubles}) THEN array_to_string(p[-3:], '.')
      ELSE array_to_string(p[-2:], '.') END AS domain FROM parts),
hosts AS (SELECT host, any_value(suffix) AS suffix, any_value(domain) AS domain, count(quality) AS n,
    coalesce(sum(quality), 0) AS good FROM placed LEFT JOIN outcomes USING (host) GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
suffixes_in AS (SELECT *, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM suffixes) AS overall FROM suffixes),
{_level("suffix", "suffixes_in", "overall")},
domains_in AS (SELECT d.*, suffix_rate FROM domains d JOIN suffix USING (suffix)),
{_level("domain", "domains_in", "suffix_rate")},
hosts_in AS (SELECT h.*, domain_rate FROM hosts h JOIN domain USING (suffix, domain)),
{_level("host", "hosts_in", "domain_rate")},
known AS (SELECT host, host_rate AS rate,
  least(1.0, host_rate + {url_reputation.Z} * sqrt(host_rate * (1 - host_rate) / (strength + n + 1))) AS rate_bound FROM host)
SELECT page_id, host, path, {rule} AS rule,
  {verdict} WHEN rate_bound < {url_reputation.MIN_GOOD} THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 9) AS rate, round(rate_bound, 9) AS rate_bound
FROM parsed JOIN known USING (host)
"""


# --- WARC derivatives ----------------------------------------------------------------------
def _digest(block: str) -> str:
    """Base 32 of a SHA-1, five bits at a time."""
    bits = f"(CAST(concat('0x', substr(sha1({block}), 1 + 5 * (i // 4), 5)) AS BIGINT) >> (5 * (3 - i % 4))) & 31"
    return f"concat('sha1:', array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', CAST(1 + ({bits}) AS BIGINT), 1)), ''))"


def _uuid(*parts: str) -> str:
    told = "md5(concat_ws(chr(1), " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), chr(2))" for p in parts) + "))"
    return f"regexp_replace({told}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.*)$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"


def _unescaped(text: str) -> str:
    name = f"regexp_extract(p, '{warc.REFERENCE}', 1)"
    number = f"CASE WHEN {name}[2:2] IN ('x', 'X') THEN CAST('0x' || {name}[3:] AS INTEGER) ELSE CAST({name}[2:] AS INTEGER) END"
    coded = f"CASE WHEN {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr({number}) END"
    named = " ".join(f"WHEN '{n}' THEN {q(sign)}" for n, sign in {**warc.ENTITIES, "amp": "&"}.items())
    sign = f"CASE WHEN {name}[1:1] = '#' THEN {coded} ELSE CASE {name} {named} END END"
    cut = f"string_split({text}, '&')"
    return f"{cut}[1] || array_to_string(list_transform({cut}[2:], lambda p: coalesce({sign} || substr(p, length({name}) + 2), '&' || p)), '')"


def _fields(*pairs: tuple[str, str]) -> str:
    return "concat(" + ", ".join(f"concat({q(name + ': ')}, CAST({value} AS VARCHAR), chr(13), chr(10))" if value != "target_uri"
        else f"CASE WHEN target_uri IS NULL THEN '' ELSE concat({q(name + ': ')}, target_uri, chr(13), chr(10)) END" for name, value in pairs) + ")"


def warc_sql(date: str) -> str:
    kind = "text/html; charset=utf-8"
    hidden, breaks = q(warc.HIDDEN), q(warc.BREAKS)
    flat = f"regexp_replace(regexp_replace(replace(regexp_replace(payload, {hidden}, ' ', 'g'), chr(10), ' '), {breaks}, chr(10), 'g'), {q(warc.TAGS)}, '', 'g')"
    links = f"array_to_string(list_transform(regexp_extract_all(payload, {q(warc.LINKS)}, 1), lambda x: concat('outlink: ', ltrim(x, concat(chr(34), chr(39))), chr(13), chr(10))), '')"
    return f"""
WITH given AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, {_uuid("page_id", "url", "html")} AS refers_to FROM pages),
http AS (SELECT *, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: {kind}', chr(13), chr(10), 'Content-Length: ',
  strlen(payload), chr(13), chr(10), chr(13), chr(10)) AS http FROM given),
records AS (SELECT *, {_digest("payload")} AS payload_digest, {_digest("concat(http, payload)")} AS response_digest FROM http),
flat AS (SELECT *, {flat} AS flat, regexp_extract(payload, {q(warc.TITLE)}, 1) AS raw_title FROM records),
texts AS (SELECT *, trim(regexp_replace(regexp_replace({_unescaped("flat")}, {q(warc.SPACES)}, ' ', 'g'), {q(warc.LINE_ENDS)}, chr(10), 'g'),
    concat(' ', chr(10))) AS plain,
  trim(regexp_replace({_unescaped("raw_title")}, '[\\x20\\t\\r\\n\\f\\x0b ]+', ' ', 'g'), ' ') AS title FROM flat),
made AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, concat({_fields(
      ("source-content-type", f"'{kind}'"), ("source-payload-digest", "payload_digest"),
      ("source-block-digest", "response_digest"), ("source-length", "strlen(payload)"), ("title", "title"))}, {links}) AS block FROM texts
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', plain FROM texts),
named AS (SELECT *, {_uuid("refers_to", "warc_type")} AS record_id, CAST(strlen(block) AS BIGINT) AS content_length,
  {_digest("block")} AS block_digest FROM made)
SELECT page_id, warc_type, record_id, refers_to, target_uri, '{date}' AS date, content_type, content_length,
  '{kind}' AS source_type, payload_digest AS source_payload_digest, block_digest, block,
  concat('WARC/1.1', chr(13), chr(10), {_fields(
      ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
      ("WARC-Target-URI", "target_uri"), ("WARC-Date", f"'{date}'"), ("WARC-Source-Content-Type", f"'{kind}'"),
      ("WARC-Source-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"),
      ("Content-Type", "content_type"), ("Content-Length", "content_length"))}, chr(13), chr(10)) AS header
FROM named
"""


# --- chat format ----------------------------------------------------------------------------
def chat_sql(attack: str) -> str:
    shown = f"regexp_replace(text, {q(chat.ESCAPE)}, '\\1\\\\\\2', 'g')"
    block = len(chat.OPEN) + 1 + len(chat.CLOSE)
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {q(attack)} UNION ALL SELECT -1, 1, 'assistant', {q(attack)}),
placed AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{chat.LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length({shown}) + CASE WHEN before = role THEN {len(chat.NEXT)} ELSE {block} + length(role) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


# --- source schedule -----------------------------------------------------------------------
def mixing_sql() -> str:
    """Targets by raising one level; slots by golden-ratio points; words by the blocks that slots take."""
    b, g = mixing.BLOCK, mixing.GOLDEN
    cycle = "[" + ", ".join(f"{w:.1f}" for w in mixing.WEIGHTS) + "]"
    return f"""
WITH slim AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    CAST(concat('0x', substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15)) AS BIGINT) AS ord
  FROM documents),
sources AS (SELECT source, sum(size) AS source_size,
    ({cycle})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight FROM slim GROUP BY source),
limits AS (SELECT *, {float(mixing.REPEATS)} * source_size AS top FROM sources),
levels AS (SELECT *, ({mixing.SHARE} * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM limits),
found AS (SELECT arg_min(level, top / weight) AS level FROM levels WHERE level < top / weight),
targets AS (SELECT source, source_size, least(top, coalesce((SELECT level FROM found) * weight, top)) AS target FROM limits),
shares AS (SELECT *, round(target) AS words, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS whole
  FROM targets),
placed AS (SELECT s.*, source_size, target, whole, words - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY ord % 1024, ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place
  FROM slim s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source),
slots AS (SELECT source, source_size, rest, CAST(ceil(source_size / {b}) AS BIGINT) AS blocks,
    CAST(whole * ceil(source_size / {b}) + ceil(rest / {b}) AS BIGINT) AS slots FROM (SELECT *, words - whole * source_size AS rest FROM shares)),
edges AS (SELECT *, sum(slots) OVER () AS n, sum(slots) OVER (ORDER BY source NULLS LAST) AS upto FROM slots WHERE slots > 0),
points AS (SELECT slot, (slot + 1) * {g} - floor((slot + 1) * {g}) AS point FROM (SELECT unnest(range(CAST((SELECT max(n) FROM edges) AS BIGINT))) AS slot)),
drawn AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS turn
  FROM points JOIN edges ON point >= CAST(upto - slots AS DOUBLE) / n AND point < CAST(upto AS DOUBLE) / n),
late AS (SELECT source, unnest(range(coalesce(have, 0), slots)) AS turn
  FROM edges e LEFT JOIN (SELECT source AS s, count(*) AS have FROM drawn GROUP BY source) ON e.source IS NOT DISTINCT FROM s),
turns AS (SELECT slot, source, turn FROM drawn UNION ALL SELECT (SELECT max(n) FROM edges) + turn, source, turn FROM late),
asked AS (SELECT slot, t.source, turn % blocks AS number, CASE WHEN turn = slots - 1 AND rest % {b} <> 0 THEN rest % {b} ELSE {b} END AS part
  FROM turns t JOIN edges e ON t.source IS NOT DISTINCT FROM e.source WHERE turn < slots),
held AS (SELECT doc_id, ord, source, place, size, unnest(range(CAST(place // {b} AS BIGINT), CAST((place + size - 1) // {b} + 1 AS BIGINT))) AS number
  FROM placed WHERE size > 0),
sums AS (SELECT doc_id, ord, h.source, place, sum(least(place + size, h.number * {b} + part) - greatest(place, h.number * {b})) AS taken, min(slot) AS first_slot
  FROM held h JOIN asked a ON h.source IS NOT DISTINCT FROM a.source AND h.number = a.number
  WHERE least(place + size, h.number * {b} + part) > greatest(place, h.number * {b}) GROUP BY ALL)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot
FROM placed p LEFT JOIN sums s ON p.doc_id IS NOT DISTINCT FROM s.doc_id AND p.ord = s.ord AND p.place = s.place AND p.size > 0
  AND p.source IS NOT DISTINCT FROM s.source
"""


# --- near duplicates and decontamination, by comparing everything that shares a shingle ------
NEAR_DUPLICATES = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE common / (x.n + y.n - common) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size, (SELECT count(*) FROM links l WHERE l.a = reach.a) AS links
FROM reach GROUP BY a
"""

LEAKS = """
WITH items AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
docs AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') AS w FROM documents),
anchors AS (SELECT item_id, len(w) AS length, unnest(range(0, len(w) - 4)) AS spot,
    unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM items WHERE len(w) >= 5),
places AS (SELECT doc_id, len(w) AS size, unnest(range(0, len(w) - 4)) AS place,
    unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM docs WHERE len(w) >= 5),
windows AS (SELECT DISTINCT doc_id, item_id, length, greatest(0, least(place - spot, size - length)) AS start FROM places JOIN anchors USING (s)),
cut AS (SELECT doc_id, item_id, length, start, i.w AS a, list_filter(d.w[start + 1:start + length], lambda x: x <> '') AS b
  FROM windows JOIN items i USING (item_id) JOIN docs d USING (doc_id)),
sets AS (SELECT *, list_transform(range(1, greatest(len(a) - 4, 1) + 1), lambda i: array_to_string(a[i:i + 4], ' ')) AS x,
    list_transform(range(1, greatest(len(b) - 4, 1) + 1), lambda i: array_to_string(b[i:i + 4], ' ')) AS y FROM cut),
counted AS (SELECT *, list_sum(list_transform(list_distinct(x), lambda s: least(len(list_filter(x, lambda t: t = s)),
    len(list_filter(y, lambda t: t = s))))) AS common FROM sets),
alike AS (SELECT *, round(common / (len(x) + len(y) - common), 9) AS similarity FROM counted)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, similarity FROM alike WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit; -1 stands for a step to the next bit."""
    eight = ", ".join(["-1"] * 8)
    steps = f"[4294967295]::BIGINT[] || flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, {eight}]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce({steps}, lambda c, x: {step}), 4294967295)"


# --- Merkle manifest: all nodes level by level, and a walk up from every leaf ---------------
def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"


def _walk(name: str, start: str, nodes: str) -> str:
    """From (id, grp, spot, n, honest, folded, path): all levels of a tree of nodes (grp, level, spot, n, h)."""
    return f"""
{name} AS (
  SELECT * FROM ({start})
  UNION ALL
  SELECT w.id, w.grp, w.level + 1, w.spot // 2, (w.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN w.honest WHEN w.spot % 2 = 1 THEN s.h || w.honest ELSE w.honest || s.h END),
         sha256(CASE WHEN s.h IS NULL THEN w.folded WHEN w.spot % 2 = 1 THEN s.h || w.folded ELSE w.folded || s.h END),
         w.path || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {nodes} s ON s.grp = w.grp AND s.level = w.level AND s.spot = xor(w.spot, 1)
  WHERE w.n > 1
)"""


def _tree(name: str, leaves: str) -> str:
    return f"""
{name} AS (
  {leaves}
  UNION ALL
  SELECT grp, level + 1, spot // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY spot)) FROM {name}
  WHERE n > 1 GROUP BY grp, level + 1, spot // 2, (n + 1) // 2
)"""


MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS grp, {_leaf("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0
              THEN {_leaf("(CAST(n_chars AS HUGEINT) + 1)")} END AS tampered
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY grp) AS n
  FROM docs
),
{_tree("nodes", "SELECT grp, 0 AS level, spot, n, leaf AS h FROM placed")},
tops AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree("above", "SELECT '' AS grp, 0 AS level, spot, n, h FROM tops")},
{_walk("up", "SELECT id, grp, 0 AS level, spot, n, leaf AS honest, coalesce(tampered, leaf) AS folded, '' AS path FROM placed", "nodes")},
reached AS (SELECT u.id, t.spot, t.n, u.honest, u.folded, u.path FROM up u JOIN tops t USING (grp) WHERE u.n = 1),
{_walk("over", "SELECT id, '' AS grp, 0 AS level, spot, n, honest, folded, path FROM reached", "above")}
SELECT d.doc_id, d.leaf, r.honest AS subroot, o.honest AS root, sha256(o.path) AS proof_sha256,
       o.folded AS folded_root, o.folded = o.honest AS verified
FROM docs d JOIN reached r USING (id) JOIN over o USING (id)
WHERE o.n = 1
"""


# --- conversation repair: (cost, edits) of each state, compared as they are ---------------------
def _best(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w.cost IS NOT NULL))"


def _edit(letter: str, cost: str, rest: str) -> str:
    return f"{{'cost': {rest}.cost + {cost}, 'audit': '{letter}' || {rest}.audit}}"


def _insertable(v: dict[str, str]) -> dict[str, str]:
    """Each state after as many as two inserts; v0 nothing yet, v1 system, v2 user, v3 assistant."""
    to = {"0": "2", "1": "2", "2": "3", "3": "2"}
    once = {s: _edit("I", "2", v[t]) for s, t in to.items()}
    twice = {s: _edit("I", "2", "(" + once[t] + ")") for s, t in to.items()}
    return {s: _best(v[s], f"({once[s]})", f"({twice[s]})") for s in to}


def _states(v: dict[str, str]) -> str:
    return ", ".join(f"{x} AS v{s}" for s, x in v.items())


def _turn_ways() -> dict[str, str]:
    stays = "r.fault IS DISTINCT FROM 'blank' AND r.fault IS DISTINCT FROM 'duplicate'"
    extra = "CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END"
    after, initial = {"0": "2", "1": "2", "2": "3", "3": "2"}, {"2": "u", "3": "a"}
    ways = {}
    for s, t in after.items():
        keep = _edit("K", f"(CASE WHEN {stays} AND r.initial = '{initial[t]}' THEN {extra} END)", f"b.v{t}")
        rerole = _edit("R", f"(CASE WHEN {stays} THEN 2 + {extra} END)", f"b.v{t}")
        opening = [_edit("K", f"(CASE WHEN {stays} AND r.initial = 's' THEN {extra} END)", "b.v1")] if s == "0" else []
        ways[s] = _best(_edit("D", "3", f"b.v{s}"), keep, rerole, *opening)
    return ways


_NONE = "{'cost': CAST(NULL AS BIGINT), 'audit': CAST(NULL AS VARCHAR)}"
_END = "{'cost': CAST(0 AS BIGINT), 'audit': ''}"
_PUNCTUATION = "[.!?]"

REPAIR = f"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm
  FROM conversations
),
harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '{_PUNCTUATION}', '', 'g') ELSE text END AS text
  FROM drawn, range(2) copies(i) WHERE harm <> 0 AND (i = 0 OR harm = 3)
),
numbered AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n,
         regexp_extract(text, '([^ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*$', 1) AS last,
         substr(role, 1, 1) AS initial
  FROM harmed
),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM numbered
),
ends AS (SELECT {_states(_insertable({"0": _END, "1": _NONE, "2": _NONE, "3": _END}))}),
back AS (
  SELECT conv, n + 1 AS i, v0, v1, v2, v3 FROM (SELECT DISTINCT conv, n FROM judged), ends
  UNION ALL
  SELECT conv, i, {_states(_insertable({s: f"w{s}" for s in "0123"}))}
  FROM (SELECT b.conv, r.i, {", ".join(f"{x} AS w{s}" for s, x in _turn_ways().items())}
        FROM back b JOIN judged r ON r.conv = b.conv AND r.i = b.i - 1)
),
least AS (SELECT conv, v0.cost AS cost, v0.audit AS audit FROM back WHERE i = 1),
walk AS (
  SELECT conv, 0 AS p, 0 AS i, 0 AS state, audit, '' AS made, false AS any_made FROM least
  UNION ALL
  SELECT w.conv, w.p + 1, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END,
         CASE WHEN e = 'D' THEN w.state WHEN e = 'K' AND r.initial = 's' THEN 1 WHEN w.state = 2 THEN 3 ELSE 2 END,
         w.audit,
         CASE WHEN e = 'D' THEN w.made ELSE w.made || CASE WHEN w.any_made THEN chr(10) ELSE '' END
              || CASE WHEN e = 'K' THEN r.role WHEN w.state = 2 THEN 'assistant' ELSE 'user' END || ':'
              || CASE WHEN e = 'I' THEN '' ELSE r.text END END,
         w.any_made OR e <> 'D'
  FROM (SELECT *, substr(audit, p + 1, 1) AS e FROM walk) w
  LEFT JOIN judged r ON r.conv = w.conv AND r.i = w.i + 1
  WHERE w.p < length(w.audit)
),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(l.audit, '') AS audit,
       sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv FROM conversations) c
LEFT JOIN counted USING (conv) LEFT JOIN least l USING (conv)
LEFT JOIN (SELECT conv, made FROM walk WHERE p = length(audit)) USING (conv)
"""
