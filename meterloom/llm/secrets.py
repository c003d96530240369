"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Everything on the scanning path is a column expression: candidates are extracted
by regular expression, their features are built from the candidate, the text
around it and the path, and the trained trees are walked by one SQL expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import without
from meterloom.session import shared_dir

_NAMED = r"(?=[AaCcPpSsTt])(?i:passw|pass|pwd|secret|token|api[_.\-]?key|access[_.\-]?key|auth(?!or)|credential|private[_.\-]?key)[A-Za-z0-9_.\-]{0,24}"
_OPEN = rf"""{_NAMED}["']?[ \t]{{0,3}}(?:[=:]{{1,2}}|=>|:=)[ \t]{{0,3}}"""
_CLOSE = r"""[^\s"',;.)\]}]"""
#: What can be a secret, each with what stands before it. A place is tried once: what comes before
#: a run of signs is part of the match, and runs are entered at their first sign only.
CANDIDATE = "|".join(
    (
        # 1-5: after a credential word and = or :, in quotes, or up to the next NAME= of a list.
        rf"""({_OPEN})(?:(["'])([^\s"']{{8,}})|(["']?)(?!(?i:bearer|basic)\s)((?:(?![&,;][A-Za-z_]{{1,32}}=)[^\s"']){{5,}}(?![&,;][A-Za-z_]{{1,32}}=){_CLOSE}))""",
        r"""([=:] ?["'])([^\s"']{8,})""",  # 6, 7: in quotes after = or :
        rf"""((?i:bearer|basic)[ \t]{{1,3}})([^\s"']{{7,}}{_CLOSE})""",  # 8, 9
        r"""(://[^\s:/@"']{0,64}:)([^\s"'/]+)(?=@)""",  # 10, 11: user:password@
        # 12, 13: a run of 16 or more signs with a digit; of NAME=VALUE the value.
        rf"""(?<![A-Za-z0-9+/_.\-=])(?=[A-Za-z0-9+/_=.\-]{{16}})(?![A-Za-z0-9_.\-]{{0,64}}?{_OPEN})((?:[A-Za-z_][A-Za-z0-9_.\-]{{0,64}}+={{1,3}}+(?=[A-Za-z0-9+/_.\-]))?+)((?=[A-Za-z+/_=.\-]*+[0-9])[A-Za-z0-9+/_=.\-]{{16,}}+)""",
    )
)
#: Groups of the pattern that stand before a candidate, and those that are one.
BEFORE, FOUND = (1, 2, 4, 6, 8, 10, 12), (3, 5, 7, 9, 11, 13)
MASK = "[SECRET]"
AT_LEAST = 0.5
TREES, DEPTH, SEED = 15, 6, 11

# Words that are written out in names, placeholders and addresses.
DICTIONARY = (
    "access account action admin api application array auth author base bearer block body book branch bucket build cache call change channel char class client code com command comment commit common "
    "config connect content count create current data database date default delete demo description detail dev device document domain dummy email empty enable end engine entry env error event example "
    "fake field file filter first folder format from function get github google group handler hash head header here hidden home host html http image import index info input insert item java key label "
    "last length level line link list load local log login mail main manager map master match max message method min mode model module name net new node none null number object option order org output "
    "owner page param parent pass password path placeholder plugin port post prefix private process profile project property public query queue read record release remote replace report request reset "
    "resource response result role root row sample schema script search secret section select send server service session set shared size source spec src start state static status step stop store "
    "string style sub system table tag target task temp template test text time title token tool tree type unit update upload url user util value version view web widget window word work world write "
    "xxxx your"
).split()

FEATURES = {
    "length": "float(least(length(c), 128))",
    "digits": "float(regexp_count(c, '[0-9]') / length(c))",
    "uppers": "float(regexp_count(c, '[A-Z]') / length(c))",
    "lowers": "float(regexp_count(c, '[a-z]') / length(c))",
    "transitions": "float(regexp_count(c, '(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]') / length(c))",
    "distinct": "float(size(array_distinct(split(substring(c, 1, 128), ''))) / least(length(c), 128))",
    "hexadecimal": "float(c rlike '^(?:[0-9a-f]+|[0-9A-F]+)$')",
    "dictionary": f"float(1 - length(regexp_replace(lower(c), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / length(c))",
    "path": "float(coalesce(lower(path) rlike '(^|[^a-z])(test|tests|spec|example|examples|sample|samples|docs|fixture|fixtures|mock)([^a-z]|$)', false))",
    "assigned": r"""float(l rlike '[=:]\\s*["\']?$')""",
    "quoted": r"""float(r rlike '^["\']')""",
    "credential": r"""float(lower(l) rlike '(token|secret|pass|pwd|api.?key|access.?key|auth|bearer|credential|private)[^\\n]{0,16}$')""",
    "harmless": r"""float(lower(l) rlike '(sha.?[0-9]*|md5|commit|checksum|digest|uuid|guid|version|https?|url|order|phone|card|example|sample|dummy|placeholder)[^\\n]{0,16}$')""",
    "userinfo": r"""float(l rlike '://[^\\s:/@]*:$' and r rlike '^@')""",
    "placeholder": r"""float(c rlike '^[$]?[{<(%]|[*]{4}|[(]')""",
    "address": r"""float(l rlike '[@/]$' or c rlike '^[a-z0-9.\\-]+[.](com|org|net|io|dev)$')""",
}


_STRUCT = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in FEATURES.items()) + ")"
_ARRAY = f"array({', '.join(FEATURES.values())})"


def _bound(sql: str) -> str:
    """The struct over a lambda variable `x` that holds c, l, r and path."""
    return re.sub(r"(?<![\w'.\[])\b(c|l|r|path)\b(?=\s*[,)]|\s+rlike|\s+or)", r"x.\1", sql)


@dataclass(frozen=True)
class Forest:
    """Trees as lists over all nodes: feature and threshold of a split, its children, the share of label 1; leaves are their own children."""

    roots: tuple = (0,)
    feature: tuple = (0,)
    threshold: tuple = (0.0,)
    left: tuple = (0,)
    right: tuple = (0,)
    share: tuple = (1.0,)
    depth: int = 0

    @property
    def sql(self) -> str:
        """The score of an array `f` of features. The lists are constants, so the expression stays small however large the trees."""
        held = lambda values, kind: f"cast(split('{' '.join(map(repr, values))}', ' ') as array<{kind}>)"
        feature, left, right, roots = (held(v, "int") for v in (self.feature, self.left, self.right, self.roots))
        threshold, share = held(self.threshold, "double"), held(self.share, "double")
        step = f"if(f[{feature}[n]] <= {threshold}[n], {left}[n], {right}[n])"
        leaf = f"aggregate(sequence(1, {self.depth}), r, (n, d) -> {step})" if self.depth else "r"
        return f"aggregate({roots}, 0D, (a, r) -> a + {share}[{leaf}]) / {len(self.roots)}"


def labelled_findings(spark: SparkSession, rows: int = 3_000) -> DataFrame:
    """Labelled findings by rule: `candidate`, `left`, `right`, `path`, `label`.

    Half are credentials in usual formats and places, half are what scanners
    mistake for them: digests, ids, addresses, numbers, paths and placeholders.
    Give `train` a table of your own reviewed findings with these columns
    instead, or united with this one.
    """
    base = spark.range(0, rows, 1, 4).withColumn("h", F.sha2(F.col("id").cast("string"), 512)).withColumn("b", F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", "x"))
    kind, pick = F.pmod("id", F.lit(36)), F.pmod(F.xxhash64("id"), F.lit(6))
    listed = F.split(F.lit(" ".join(DICTIONARY)), " ")  # one constant, where an array would be a literal for each word
    word = lambda k: F.element_at(listed, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    num = F.regexp_replace(F.col("h"), "[a-f]", "")
    two = F.concat(word(1), F.lit("_"), word(2))
    made = [
        F.substring("h", 1, 40), F.upper(F.substring("h", 1, 40)), F.substring("h", 1, 64), F.substring("h", 1, 32), F.substring("b", 1, 40),
        F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16))), F.concat(F.lit("ghp_"), F.substring("b", 1, 36)), F.concat(F.lit("sk_live_"), F.substring("b", 1, 24)), F.concat(F.substring("b", 1, 20), F.lit("."), F.substring("b", 21, 40)), F.substring("b", 1, 14),
        F.substring("h", 1, 40), F.substring("h", 1, 64), F.regexp_replace(F.substring("h", 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.concat(word(3), F.substring(num, 1, 1), F.lit("."), word(4), F.lit(".com")), F.substring(num, 1, 16),
        F.concat(word(5), F.lit("/"), two, F.substring(num, 1, 2), F.lit(".py")), F.concat(F.lit("your_"), two, F.lit("_here_"), F.substring(num, 1, 1)), F.concat(two, F.lit("_"), word(6), F.substring(num, 1, 2)), F.concat(F.lit("20"), F.substring(num, 1, 2), F.lit("-01-0"), F.substring(num, 3, 1), F.lit("-"), two), F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.substring(num, 1, 1)),
    ]
    letters = F.translate("h", "0123456789", "ghkmnprstw")
    one = lambda k, *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    chosen = F.when(pick < 2, F.concat(F.initcap(F.substring(letters, 1, 6)), F.substring(num, 1, 4))).when(pick < 4, F.concat(one(8, "Winter", "Summer", "Dragon", "Monkey", "Sunshine", "Charlie"), F.substring(num, 1, 4))).otherwise(F.concat(one(9, "s3cr3t", "P@ssw0rd", "Tr0ub4dor", "L3tM3in", "p@ss$w0rd", "hunt3r"), one(10, "!", "!longer", "#1", "&3", "")))
    made += [chosen, chosen, chosen, F.substring(letters, 1, 22), F.substring(letters, 9, 30), F.concat(F.substring("b", 1, 12), F.lit("/"), F.substring("b", 13, 14), F.lit("+"), F.substring("b", 30, 12)), F.concat(F.substring("b", 1, 7), F.lit("!$"), F.substring("b", 9, 5)), F.substring("b", 1, 32)]
    long_word = one(11, "required", "optional", "disabled", "undefined", "changed", "something", "expired", "forgotten", "instructions", "therefore", "bondholder", "string", "function")
    made += [long_word, F.concat(F.lit("${"), F.upper(two), F.lit("}")), F.concat(F.lit("<"), word(12), F.lit("-"), word(13), F.lit(">")), F.concat(F.lit("get_"), two, F.lit("()")), long_word, F.lit("********"), F.substring("h", 1, 40), F.concat(word(14), F.lit("."), two)]
    keyed = ['token = "', "api_key: '", 'SECRET="', "password = '", "Authorization: Bearer ", "access_key="]
    plain = [["commit ", "sha1 "], ["sha256:", "checksum "], ["uuid: ", "id "], ["someone@", "http://"], ["order ", "and "], ["in ", "from "], ['token = "', 'api_key = "'], ["call ", "name: "], ["at ", "date: "], ['password = "', "secret: '"]]
    at = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(pick, F.lit(len(options))) + 1).cast("int"))
    asked = ["password: ", "DB_PASS=", "pass = ", "pwd=", 'passwd = "', "MYSQL_PASSWORD="]
    named = ["AWS_SECRET_ACCESS_KEY=", "API_KEY=", "auth_token: ", "CLIENT_SECRET=", "token=", "secret: "]
    urls = ["postgres://bob:", "https://user:", "DATABASE_URL=mysql://root:", "redis://:", "amqp://app:", "mongodb://admin:"]
    lefts = [at(keyed)] * 10 + [at(p) for p in plain]
    lefts += [at(asked), at(asked), at(urls), F.lit("Authorization: Bearer "), at(named), at(named), at(asked), at(named)]
    lefts += [at(asked + named), at(asked), at(named), at(asked), F.lit("the bearer "), at(asked), at(["commit=", "build_id=", "sha1=", "GIT_COMMIT=", "etag=", "digest="]), at(named)]
    choose = lambda columns: F.element_at(F.array(*columns), (kind + 1).cast("int"))
    left = F.concat(word(7), F.lit(" "), choose(lefts))
    right = F.when(F.substring(left, -1, 1).isin("'", '"'), F.substring(left, -1, 1)).otherwise(F.lit(" "))
    right = F.when(kind == 22, F.lit("@db.internal")).otherwise(right)
    path = F.when(kind.isin(16, 19) & (pick < 3), "tests/fixture.py").otherwise(F.concat(F.lit("src"), kind.cast("string")))
    return base.select(choose(made).alias("candidate"), left.alias("left"), right.alias("right"), path.alias("path"), ((kind < 10) | kind.between(20, 27)).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit the forest on labelled findings; rows with a null candidate or label are left out.

    Without rows, or with one label only, every candidate gets the share of
    label 1 (1.0 without rows: nothing is known to be false).

    Findings and features are checkpointed, which keeps the rows of every
    partition in order: no job of the fit carries the expressions they come from.
    """
    shared_dir(findings.sparkSession)
    known = findings.where("candidate is not null and candidate <> '' and label is not null").checkpoint()
    share = known.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if share[0] is None or share[1] == share[2]:
        return Forest(share=(1.0 if share[0] is None else float(share[0]),))
    rows = known.selectExpr(f"transform(array(named_struct('c', candidate, 'l', coalesce(left, ''), 'r', coalesce(right, ''), 'path', path)), x -> {_bound(_STRUCT)})[0] as f", "double(label) as label").select("f.*", "label").checkpoint()
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(vector)
    nodes: list = []

    def add(node) -> int:
        number = len(nodes)
        nodes.append((0, 0.0, number, number, 0.0))
        if node.subtreeDepth() == 0:
            counts = list(node.impurityStats().stats())
            nodes[number] = (0, 0.0, number, number, round(counts[1] / sum(counts), 6))
        else:
            split = node.split()
            nodes[number] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), 0.0)
        return number

    roots = tuple(add(t._call_java("rootNode")) for t in model.trees)
    return Forest(roots, *zip(*nodes), depth=max(t.depth for t in model.trees))


_MARK = "\ufdd0"


def _named_groups(pattern: str) -> str:
    """Number the plain groups of a pattern by name, so that the next digit of a replacement can't be misread."""
    count = iter(range(1, 100))
    return re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?<g{next(count)}>", pattern)


def _let(value: str, name: str, body: str) -> str:
    """SQL with a value computed once, however often the body (and its lambdas) use it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scored(docs: DataFrame, forest: Forest, text_col: str, path_col: str | None) -> DataFrame:
    """Add `__found`: candidates `c`, the gaps around them `g` and a score for each.

    The pattern runs once: it sets marks around candidates, and the text is cut
    at the marks.
    """
    text, path = F.col(f"`{text_col}`"), f"`{path_col}`" if path_col else "cast(null as string)"
    # A sign that Unicode keeps free for such use; a text that has it gets a mark made of its own hash.
    mark = F.when(F.instr(text, _MARK) == 0, F.lit(_MARK)).otherwise(F.concat(F.lit(_MARK), F.hex(F.xxhash64(text)), F.lit(_MARK)))
    before, found = ("".join(f"${{g{k}}}" for k in ks) for ks in (BEFORE, FOUND))
    rows = docs.withColumn("__mark", mark)
    marked = F.regexp_replace(text, F.lit(_named_groups(CANDIDATE)), F.concat(F.lit(before), F.col("__mark"), F.lit(found), F.col("__mark")))
    rows = rows.withColumn("__cut", F.coalesce(F.split(marked, F.col("__mark"), -1), F.array(F.lit(""))))
    place = f"named_struct('c', c, 'l', right(s.g[i], 80), 'r', left(s.g[i + 1], 20), 'path', {path})"
    scores = f"transform(s.c, (c, i) -> transform(transform(array({place}), x -> {_bound(_ARRAY)}), f -> {forest.sql})[0])"
    parts = _let("__cut", "u", _let("named_struct('c', filter(u, (x, i) -> i % 2 = 1), 'g', filter(u, (x, i) -> i % 2 = 0))", "s", f"named_struct('c', s.c, 'g', s.g, 'score', {scores})"))
    return rows.withColumn("__found", F.expr(parts))


def _starts(step: int = 512) -> str:
    """SQL of the offsets of candidates, from the lengths of `s.c` and `s.g`; added up in steps, since an array that grows is copied."""
    empty = "named_struct('at', 0, 'out', cast(array() as array<int>))"
    inside = f"aggregate(slice(z, k * {step} + 1, {step}), {empty}, (a, e) -> named_struct('at', a.at + e.g + e.c, 'out', array_append(a.out, a.at + e.g)))"
    parts = f"transform(sequence(0, greatest(size(z) - 1, 0) div {step}), k -> {inside})"
    bases = f"aggregate(p, {empty}, (a, e) -> named_struct('at', a.at + e.at, 'out', array_append(a.out, a.at)), a -> a.out)"
    return _let("transform(s.c, (c, i) -> named_struct('g', length(s.g[i]), 'c', length(c)))", "z", _let(parts, "p", f"flatten(zip_with(p, {bases}, (e, b) -> transform(e.out, o -> o + b)))"))


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, at_least: float = AT_LEAST) -> DataFrame:
    """Add `findings`: start, end (character offsets, end exclusive) and score of every secret in a text.

    Null and empty texts have none. A column named `findings` is replaced, all
    others pass through; repeated rows are scanned each.
    """
    kept = without(docs, ["findings"])
    places = f"zip_with({_starts()}, s.c, (o, c) -> named_struct('start', o, 'end', o + length(c)))"
    found = f"filter(zip_with({places}, s.score, (p, q) -> named_struct('start', p.start, 'end', p.end, 'score', q)), s -> s.score >= {float(at_least)})"
    return _scored(kept, forest, text_col, path_col).select(*[F.col(f"`{c}`") for c in kept.columns], F.expr(_let("__found", "s", found)).alias("findings"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, at_least: float = AT_LEAST, mask: str = MASK) -> DataFrame:
    """`docs` with every secret in the text replaced by `mask`; null texts stay null, all rows stay."""
    rows = _scored(docs, forest, text_col, path_col)
    masked = f"concat(s.g[0], array_join(transform(s.c, (c, i) -> concat(if(s.score[i] >= {float(at_least)}, '{mask}', c), s.g[i + 1])), ''))"
    whole = F.when(F.col(f"`{text_col}`").isNotNull(), F.expr(_let("__found", "s", masked)))
    return rows.withColumn(text_col, whole).select(*[F.col(f"`{c}`") for c in docs.columns])
