"""Secret scan: regex candidates, a random forest against false positives, all native.

Candidates are long runs of key characters, and values of any kind after secret-like names. Each is described by its length, its character classes and the changes
between them, how much of it dictionary words cover, whether it stands in a path, and its neighbouring words. A random
forest trained on labelled findings decides; its trees become one SQL expression, so scoring is a projection over the
documents: no shuffle, no Python, no explode.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

#: How known kinds of keys begin.
_PREFIXES = "AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|eyJ|AIza|glpat-|npm_"
#: Ends of names that stand before secrets; _ is one of _, - and blank, or nothing.
_NAMES = "token secret password passwort passwd passphrase passcode pass pwd auth credential credentials api_key access_key secret_key private_key client_key auth_key".split()


def _after_name() -> str:
    """Stands after a name, a sign of assignment and a quote at most. Each lookbehind has one width, as Python's re asks for."""
    widths: dict[int, list[str]] = {}
    for name in _NAMES:
        for gap in ("", "[_ -]") if "_" in name else ("",):
            parts = ["".join(f"[{c.upper()}{c}]" for c in x) for x in name.split("_")]
            widths.setdefault(len(name) - name.count("_") + (gap != ""), []).append(gap.join(parts))
    out = ["(?<=[Bb][Ee][Aa][Rr][Ee][Rr] )"]
    for quote in ("", "[\"`\\x27]", r"\\[\"\x27]"):
        for blank in ("", "[ \\t]"):
            for sign in ("[:=]", "=>", ":="):
                for before in ("", "[ \\t\"\\x27]", "[\"\\x27] "):
                    sep = before + sign + blank + quote
                    names = "|".join(f"(?<=(?:{'|'.join(x)}){sep})" for x in widths.values())
                    out.append(f"(?<={sep})(?:{names})")
    # few places follow a sign at all, which a handful of looks tells before the names are tried
    near = "|".join(f"(?<={x})" for x in ("[:=>]", "[:=>][ \\t\"`\\x27]", "[:=>][ \\t][\"`\\x27]", r"[:=>]\\[\"\x27]", r"[:=>][ \t]\\[\"\x27]", "[Rr] "))
    return f"(?:{near})(?:" + "|".join(out) + ")"


_KEY = r"[A-Za-z0-9+/_\-]"
#: '=' is part of a candidate as padding only, not where a value follows it.
_PAD = rf"(?:={{1,2}}(?!{_KEY}|=))?"
#: A candidate, not inside a longer run: after a secret-like name any value of 4 characters or more; elsewhere a run of
#: 16 key characters or more, with a digit or a known prefix.
CANDIDATE = (
    rf"(?<!{_KEY})(?:(?<=[:=> \t\"`\x27])(?=[A-Za-z0-9+/_\-!@#$%^*~.]{{4}}){_after_name()}[A-Za-z0-9+/_\-!@#$%^*~.]{{3,}}[A-Za-z0-9+/_\-!@#$%^*~]{_PAD}"
    rf"|(?=[A-Za-z+/_\-]*[0-9]|(?:{_PREFIXES})){_KEY}{{16,}}{_PAD})"
)
WORDS = (
    "example sample test dummy your here key token secret password user name data http https html index path file image static assets content page post article "
    "version release commit build class function return value config default module package import export public private service account login session "
    "the and that with from this have not for are was will you com org net www api lib src main readme lorem ipsum dolor tion ing ment ment able ness"
).split()
_WORD_RE = "(?:" + "|".join(sorted(set(w for w in WORDS if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
_NEAR_GOOD = r"(?i)(?:token|secret|passw|pwd|api[_ \-]?key|access[_ \-]?key|auth|bearer|credential|private[_ \-]?key|client[_ \-]?key)"
_NEAR_BAD = r"(?i)(?:commit|sha-?\d|checksum|digest|md5|uuid|guid|etag|hash|example|revision|build|order|invoice|isbn|phone|tracking|integrity)"
_PREFIX = f"^(?:{_PREFIXES})"

def _sql(pattern: str) -> str:
    """A pattern as a SQL text."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _left(pattern: str, of: str = "v") -> str:
    """The share of a text that is left without what matches."""
    return f"length(regexp_replace({of}, {_sql(pattern)}, '')) / length(v)"


#: Name and SQL of each feature of a candidate v between the texts before and after.
FEATURES = {
    "f_len": "cast(length(v) as double)",
    "f_digit": _left("[^0-9]"),
    "f_upper": _left("[^A-Z]"),
    "f_sign": _left("[A-Za-z0-9]"),
    "f_hex": f"cast(v rlike {_sql('^[0-9a-f]+$')} or v rlike {_sql('^[0-9A-F]+$')} as double)",
    "f_change": f"(length(regexp_replace(v, {_sql('(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])')}, '#')) - length(v)) / length(v)",
    "f_distinct": "size(array_distinct(split(v, ''))) / least(length(v), 64)",
    "f_words": f"1 - {_left(_WORD_RE, 'lower(v)')}",
    "f_vowels": _left("[^aeiouy]", "lower(v)"),
    "f_letters": f"length(regexp_extract(v, {_sql('[A-Za-z]{7,}')}, 0)) / length(v)",
    "f_path": f"cast(before rlike {_sql('[a-z]:/{0,2}[^ ]*$|[./~]$|/[^ ]*$')} or v rlike {_sql('^/|/[a-z]{3,}/|[a-z]+/[a-z]+/')} or after rlike {_sql(r'^[.][a-z]{2,4}\b')} as double)",
    "f_uuid": f"cast(v rlike {_sql('^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')} as double)",
    "f_prefix": f"cast(v rlike {_sql(_PREFIX)} as double)",
    "f_good": f"cast(before rlike {_sql(_NEAR_GOOD)} as double)",
    "f_bad": f"cast(before rlike {_sql(_NEAR_BAD)} or after rlike {_sql('^.?.?(?i)(?:example|checksum|commit)')} as double)",
    "f_assign": "cast(before rlike " + _sql("(?:[:=]|=>)[ \t]*[\"`']?$") + " as double)",
    "f_quote": "cast(before rlike " + _sql("[\"`']$") + " and after rlike " + _sql("^[\"`']") + " as double)",
}
TREES, DEPTH = 24, 6


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(v, before, after, label): findings labelled 1 where they are secrets, generated by kind from a seeded hash.

    The tables hold no labelled findings. The kinds are written from public knowledge: how providers describe their keys,
    how assignments and headers look, and what scanners are known to report wrongly (digests, identifiers, paths, names in
    code, placeholders, long numbers). They were not taken from the texts that are scanned.
    """
    hexes = "lower(hex(unhex(md5(concat('{s}', id)))))"
    h = lambda s, n: f"substring(concat({hexes.format(s=s)}, {hexes.format(s=s + 'x')}, {hexes.format(s=s + 'y')}), 1, {n})"
    b64 = lambda s, n: f"substring(translate(base64(unhex(concat({hexes.format(s=s)}, {hexes.format(s=s + 'q')}, {hexes.format(s=s + 'r')}))), '+/', '{{}}'), 1, {n})"
    b = lambda s, n, r="+/": b64(s, n).replace("{}", r)
    pick = lambda *xs: "element_at(array(" + ", ".join(f"'{x}'" for x in xs) + f"), cast(1 + pmod(xxhash64(id, {sum(map(ord, xs[0])) + len(xs)}), {len(xs)}) as int))"
    name = pick("token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "private_key", "API-KEY", "passwd")
    sep = pick(' = "', ": ", "=", ' = \\\'', ":", '=\\"', ' => "')
    after = pick('" and the', "", " ", '" der', "\\\\n", '", ')
    prose = pick("the report of ", "see also ", "und dann ", "value ", "we saw ", "id ", "ref ", "number ", "que la ")
    word = pick("required", "string", "optional", "undefined", "disabled", "expired", "invalid", "missing", "placeholder", "changeme", "None", "null", "true", "false", "rotation", "management", "policy", "reset", "vergessen", "oublie", "olvidada", "which", "there", "Basic", "generator", "authentication", "********", "xxxxxxxx", "process.env.TOKEN", "$PASSWORD", "protected")
    kinds = [
        (f"concat({prose}, {name}, {sep})", h("a", 40), after, 1),
        (f"concat({prose}, {name}, {sep})", b("b", 40), after, 1),
        (f"concat({prose}, {name}, {sep})", h("c", 32), after, 1),
        (f"concat({name}, {sep})", b("d", 24, "_-"), after, 1),
        (prose, f"concat('AKIA', upper({h('e', 16)}))", after, 1),
        (f"concat({name}, {sep})", f"concat('ghp_', {b('f', 36, 'ab')})", after, 1),
        (prose, f"concat('xoxb-', {h('g', 12)}, '-', {b('h', 24, 'ab')})", after, 1),
        (f"concat('Authorization: Bearer ', '')", f"concat('eyJ', {b('i', 60, '_-')})", after, 1),
        (prose, f"concat('sk_live_', {b('j', 24, 'ab')})", after, 1),
        (f"concat({prose}, {name}, {sep})", f"translate({b('A', 12, 'kW')}, '0123456789', 'qZxKvJwPgB')", after, 1),
        (f"concat({name}, {sep})", f"concat({b('B', 7, 'kW')}, pmod(id, 10))", after, 1),
        (f"concat({name}, {sep})", f"translate({h('C', 10)}, '0123456789', 'qzxkvjwpgt')", after, 1),
        (f"concat({prose}, {name}, {sep})", f"concat({pick('hunter', 'Summer', 'dragon', 'Winter', 'monkey', 'sommer', 'Soleil', 'qwerty')}, pmod(id, 1000), {pick('!', '', '#', '$', '!!')})", after, 1),
        (f"concat({pick('AWS_SECRET_ACCESS_KEY', 'export DB_PASSWORD', 'API_TOKEN', 'CLIENT_SECRET', 'https://host.org/v1/x?api_key', 'GET /a?n=1&access_token')}, '=')", b("D", 40), pick("\\n", "&x=1", " ", ""), 1),
        (f"concat({prose}, {name}, {sep})", word, after, 0),
        (f"concat({name}, {sep})", word, after, 0),
        (f"concat({pick('commit ', 'sha1 ', 'sha-256: ', 'revision ', 'md5 = ', 'checksum: ')}, '')", h("k", 40), "' in the '", 0),
        (f"concat({pick('digest: ', 'etag=', 'integrity ', 'hash ', 'build ')}, '')", h("l", 64), "' '", 0),
        (f"concat({pick('uuid ', 'id: ', 'request ', 'guid=', 'session ')}, '')", f"concat({h('m', 8)}, '-', {h('n', 4)}, '-', {h('o', 4)}, '-', {h('p', 4)}, '-', {h('q', 12)})", "' '", 0),
        (f"concat({pick('https://host.org/', 'file:///usr/lib/', '/static/assets/', 'src/main/')}, '')", f"concat('content/page', {h('r', 3)}, '/article-index-', {h('s', 4)})", pick(".html", ".png", "/x"), 0),
        (prose, f"concat('getDefaultServiceAccount', pmod(id, 97), 'FromConfigModule')", "' '", 0),
        (f"concat({name}, {sep})", f"concat({pick('YOUR_TOKEN_HERE_', 'example-secret-key-', 'dummy_password_', 'sample-token-value-')}, pmod(id, 1000))", after, 0),
        (f"concat({name}, {sep})", f"repeat(cast(pmod(id, 10) as string), 24)", after, 0),
        (f"concat({name}, {sep})", f"repeat({pick('x0', 'abc1', '0000', 'X1')}, 10)", after, 0),
        (f"concat({pick('order ', 'tracking ', 'phone ', 'isbn ', 'on the ', 'invoice ')}, '')", f"translate({h('t', 20)}, 'abcdef', '123456')", "' '", 0),
        (prose, f"concat(translate({h('u', 16)}, 'abcdef', '789012'), '')", "' re '", 0),
        (prose, f"concat(translate({h('v', 14)}, '0123456789', 'tionherean'), pmod(id, 10), translate({h('w', 8)}, '0123456789', 'tionherean'))", "' '", 0),
    ]
    cases = lambda i: "case pmod(id, {n}) ".format(n=len(kinds)) + " ".join(f"when {k} then {x[i]}" for k, x in enumerate(kinds)) + " end"
    return spark.range(rows).selectExpr(f"{cases(1)} as v", f"{cases(0)} as before", f"{cases(2)} as after", f"cast({cases(3)} as double) as label")


def train_forest(findings: DataFrame, seed: int = 5) -> str:
    """SQL of the share of trees that call a finding a secret, over the columns of FEATURES."""
    rows = findings.selectExpr("label", *[f"cast({sql} as double) as {name}" for name, sql in FEATURES.items()])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "label").coalesce(2)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    names = list(FEATURES)

    def walk(node) -> str:
        if node.subtreeDepth() == 0:
            return str(int(node.prediction()))
        split = node.split()
        return f"if(c.{names[split.featureIndex()]} <= {split.threshold()!r}D, {walk(node.leftChild())}, {walk(node.rightChild())})"

    trees = [walk(t.rootNode()) for t in model._java_obj.trees()]
    return "(" + " + ".join(trees) + f") / {float(len(trees))}D"


#: Neighbouring words that a finding is judged by.
WORDS_BEFORE, WORDS_AFTER = 7, 3


def scan(docs: DataFrame, forest: str, text_col: str = "text", threshold: float = 0.5, names: tuple[str, str] | None = None) -> DataFrame:
    """docs with two columns (of the given names, else __gaps and __found): the texts between candidates, and an array of
    (v, score, secret), one for each candidate in order. Other columns stay, whatever their names.

    Null and empty texts have no candidates; values that occur repeatedly are judged each in its place; repeated rows are
    scanned each; an empty table gives no rows. A text of any length is scanned whole.
    """
    pattern = CANDIDATE.replace("\\", "\\\\")
    whole, values = unused(docs, "__text"), unused(docs, "__v")
    gaps, found = names or ("__gaps", "__found")
    own = docs.withColumn(whole, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    parts = own.withColumn(values, F.expr(f"regexp_extract_all({whole}, '{pattern}', 0)"))
    parts = parts.withColumn(gaps, F.when(F.size(values) > 0, F.split(whole, CANDIDATE, -1)))
    struct = ", ".join(f"'{n}', cast({sql} as double)" for n, sql in FEATURES.items())
    plain = "translate({}, '\\n\\t\\r', '   ')"
    before = f"substring_index(concat(if(i > 0, {values}[i - 1], ''), {plain.format(f'{gaps}[i]')}), ' ', -{WORDS_BEFORE})"
    after = f"substring_index({plain.format(f'{gaps}[i + 1]')}, ' ', {WORDS_AFTER})"
    sql = (
        f"transform(transform(transform({values}, (v, i) -> named_struct('v', v, 'before', {before}, 'after', {after})),"
        f" s -> named_struct('v', s.v, {_in_struct(struct)})),"
        f" c -> named_struct('v', c.v, 'score', {forest}))"
    )
    out = parts.withColumn(found, F.expr(sql))
    marked = F.expr(f"transform({found}, c -> named_struct('v', c.v, 'score', c.score, 'secret', c.score >= {threshold}D))")
    return out.withColumn(found, marked).drop(whole, values)


def _in_struct(sql: str) -> str:
    """FEATURES speak of v, before and after; inside the lambda those are fields of s."""
    out = []
    for part in re.split(r"('(?:[^'\\]|\\.)*')", sql):
        out.append(part if part.startswith("'") else re.sub(r"\b(v|before|after)\b", r"s.\1", part))
    return "".join(out)


def redact(docs: DataFrame, forest: str, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text_col replaced by mark; all rows and columns stay, null texts stay null."""
    gaps, found = unused(docs, "__gaps"), unused(docs, "__found")
    scanned = scan(docs, forest, text_col, names=(gaps, found))
    filled = F.expr(f"concat(array_join(zip_with(slice({gaps}, 1, size({found})), {found}, (g, c) -> concat(g, if(c.secret, '{mark}', c.v))), ''), element_at({gaps}, -1))")
    text = F.when(F.expr(f"exists({found}, c -> c.secret)"), filled).otherwise(F.col(f"`{text_col}`"))
    return scanned.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def starts_of(gaps: str = "__gaps", found: str = "__found"):
    """Array of the candidates' first places. Sums are carried over blocks of 64, so it is linear but for a 4096th."""
    steps = f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, c) -> length(g) + length(c.v))"
    return F.expr(
        f"""transform(array({steps}), s -> transform(array(aggregate(transform(sequence(0, greatest(0, (size(s) - 1) div 64)), j -> aggregate(slice(s, j * 64 + 1, 64), 0, (a, x) -> a + x)),
        named_struct('at', 0, 'all', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x, 'all', concat(a.all, array(a.at)))).all), b ->
        transform(s, (x, i) -> b[i div 64] + aggregate(slice(s, (i div 64) * 64 + 1, i % 64), 0, (a, y) -> a + y) + length({gaps}[i])))[0])[0]"""
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate of each document: doc_id, nth, start (code points), length, value_sha256, score, is_secret."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train_forest(labelled_findings(spark))).select("doc_id", "__gaps", "__found")
    placed = F.arrays_zip(starts_of().alias("start"), F.col("__found").alias("c"))
    each = found.where(F.size("__found") > 0).select("doc_id", F.posexplode(placed).alias("nth", "p")).select("doc_id", "nth", "p.start", "p.c")
    return each.select("doc_id", "nth", "start", F.length("c.v").alias("length"), F.sha2("c.v", 256).alias("value_sha256"), "c.score", F.col("c.secret").alias("is_secret"))
