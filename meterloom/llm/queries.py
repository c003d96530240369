"""Registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import bpe, chosenpath, decontaminate, divergence, fixity, language, licenses, periodic, quality, secrets, simhash, topk, toxicity
from meterloom.llm.common import fold, table
from meterloom.session import settle_mapped


def vocabulary_path() -> str:
    """The public vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


#: Pages written to one WARC file.
PER_FILE = 4_096


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, against a second copy with records changed, cut out and added; what follows them moves."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.floor(F.col("page_id") / PER_FILE).alias("file"))
    record = fixity.record("url", "page_id", "html")
    primary = pages.select("file", "page_id", F.lit(0).alias("part"), record.alias("record"))
    bad = F.overlay("record", F.lit(b"#"), F.octet_length("record") - 4)
    kept = primary.where("page_id % 192 <> 40").withColumn("record", F.when(F.col("page_id") % 96 == 5, bad).otherwise(F.col("record")))
    added = pages.where("page_id % 384 = 200").withColumn("page_id", -F.col("page_id")).select("file", (-F.col("page_id")).alias("page_id"), F.lit(1).alias("part"), record.alias("record"))
    sides = (fixity.leaves(x, offset_col=None, order=["page_id", "part"]) for x in (primary, kept.unionByName(added)))
    return fixity.audit(*sides)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark)), path_col="source")
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.start", "f.end", "f.score")


def _scored(operator, label: str, at: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        labels = table(spark, sf_dir, "labels").select("doc_id", label)
        learn = fold("doc_id", 5) != 0
        model = operator.train(docs.where(learn), labels.where(learn))
        scored = operator.score(docs, model)
        return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))

    return query


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("vector"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = bpe.prepare(docs, vocabulary_path())
    coded = bpe.encode(docs, codec).select("doc_id", "ids")
    digests = bpe.decode(coded, codec).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    return settle_mapped(digests, "digests")


def op11_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the ids with their tail replaced by one period, over and over."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    tail = words.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("int(g % size(w))")).withColumn("p", F.expr("int(1 + floor((size(w) - a) / (3 + g % 8)))"))
    periodic_text = F.expr("array_join(concat(slice(w, 1, a), transform(sequence(0, size(w) - a - 1), i -> w[a + i % p])), ' ')")
    return tail.select("doc_id", F.when(F.expr("size(w) > 0"), periodic_text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", periodic.greatest())
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_top_k": op2_top_k,
    "op3_bpe": op3_bpe,
    "op4_licences": op4_licences,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_fixity": op7_fixity,
    "op9_secrets": op9_secrets,
    "op8_toxicity": _scored(toxicity, "toxic", 0.5),
    "op10_quality": _scored(quality, "quality", 0.3),
    "op11_near_copies": op11_near_copies,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_divergence": op13_divergence,
}


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT}', '\\1', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9\n]+', ' ', 'g')"
    for pattern, one in licenses.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{one}', 'g')"
    return out


def _known_sql() -> str:
    rows = [(k, t.replace("'", "''")) for k, texts in licenses.KNOWN.items() for t in texts]
    return ", ".join(f"('{k}', '{t}')" for k, t in rows)


ORACLE: dict[str, str] = {
    "op4_licences": f"""
        with k as (
            select distinct licence, sha256(trim(regexp_replace({_canonical_sql("t")}, '[ \n]+', ' ', 'g'))) as digest
            from (values {_known_sql()}) v(licence, t)
        ),
        c as (select doc_id, {_canonical_sql("text")} as form from documents where text is not null),
        u as (
            select doc_id, 0 as line, trim(regexp_replace(form, '[ \n]+', ' ', 'g')) as unit from c
            union all
            select doc_id, unnest(range(1, len(string_split(form, chr(10))) + 1)), trim(unnest(string_split(form, chr(10)))) from c
        )
        select doc_id, line::int as line, licence, digest from (select doc_id, line, sha256(unit) as digest from u where unit <> '') join k using (digest)
    """,
    "op7_fixity": f"""
        with i as (select page_id, page_id // {PER_FILE} as file, coalesce(url, '') as url, coalesce(html, '') as html from pages),
        x as (select *, 0 as part, page_id as name from i union all select *, 1, -page_id from i where page_id % 384 = 200),
        r as (
            select page_id, file, part, html, 'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || name || '>\r\nWARC-Target-URI: ' || url
                || '\r\nContent-Length: ' || strlen(html) || '\r\n\r\n' || html as body
            from x
        ),
        d as (
            select page_id, file, part, strlen(body) + 4 as size, sha256(body || '\r\n\r\n') as digest,
                case when part = 0 and page_id % 96 = 5 then sha256(encode(body)[: strlen(body) - 1] || encode('#\r\n\r\n')) else sha256(body || '\r\n\r\n') end as other
            from r
        ),
        p as (select *, sum(size) over (partition by file order by page_id, digest rows unbounded preceding) - size as begins from d where part = 0),
        q as (select *, sum(size) over (partition by file order by page_id, part, other rows unbounded preceding) - size as begins from d where part = 1 or page_id % 192 <> 40)
        select file, p.begins::bigint as "offset", null::bigint as replica_offset, 'missing' as fault, digest as primary_digest, null as replica_digest from p where page_id % 192 = 40
        union all select p.file, p.begins::bigint, q.begins::bigint, 'changed', p.digest, q.other from p join q on p.page_id = q.page_id and p.part = q.part where p.page_id % 96 = 5
        union all select file, begins::bigint, begins::bigint, 'extra', null, other from q where part = 1
    """,
    "op2_top_k": """
        with v as (
            select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
            where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ), p as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
        ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from p)
        select query_id, n::int as rank, vec_id, score from r where n <= 5
    """,
    "op6_decontamination": f"""
        with d as (select distinct doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents),
        b as (select distinct item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from benchmark),
        dp as (select doc_id, w, unnest(range(greatest(len(w) - {decontaminate.WORDS} + 1, 1))) as p from d where len(w) > 0),
        bp as (select item_id, w, unnest(range(greatest(len(w) - {decontaminate.WORDS} + 1, 1))) as p from b where len(w) > 0),
        bs as (select distinct item_id, array_to_string(w[p + 1 : p + {decontaminate.WORDS}], ' ') as s from bp),
        n as (select item_id, count(*) as n from bs group by 1),
        h as (
            select doc_id, item_id, unnest([p // {decontaminate.STRIDE}, p // {decontaminate.STRIDE} - 1]) as passage, s
            from (select doc_id, p, array_to_string(w[p + 1 : p + {decontaminate.WORDS}], ' ') as s from dp) join bs using (s)
        ),
        c as (select doc_id, item_id, passage, count(distinct s) as k from h where passage >= 0 group by 1, 2, 3)
        select doc_id, item_id, max(k / n) as overlap, count(*) as passages from c join n using (item_id)
        where k / n >= {decontaminate.SHARE} - 1e-9 group by 1, 2
    """,
    "op13_divergence": """
        with d as (
            select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
            from documents
        ),
        t as (select lang, source, r, unnest(w) as term from d),
        c as (select lang, source, term, count(*) as n, count(distinct r) as m from t group by all),
        k as (select lang, term, sum(n) as n from c group by all having sum(m) >= 10),
        v as (select lang, count(*) as v, sum(n) as n from k group by lang),
        s as (select c.lang, c.source, sum(c.n) as n from c join k using (lang, term) group by all),
        f as (
            select lang, source, coalesce(s.n, 0)::hugeint as n, coalesce(v.v, 0)::hugeint as v, coalesce(v.n, 0)::hugeint as ln
            from (select distinct lang, source from d) left join s using (lang, source) left join v using (lang)
        ),
        e as (
            select f.lang, f.source, k.term, coalesce(c.n, 0) as n,
                1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (f.n + 2 * f.v) as p, 1 + (1000000000::hugeint * (k.n + 2)) // (f.ln + 2 * f.v) as q
            from f join k using (lang) left join c on c.lang = f.lang and c.source = f.source and c.term = k.term
        ),
        m as (
            select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
            from e a join e b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ),
        o as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(m.value, 0)::bigint as value
            from f a join f b on a.lang = b.lang and a.source <> b.source left join m on m.lang = a.lang and m.source = a.source and m.item = b.source
            union all
            select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from e where n > 0 and p > q
        ),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from o)
        select * from r where part = 'pair' or rank <= 10
    """,
}
