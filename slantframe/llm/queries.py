"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of embeddings for every row whose id is divisible by 20."""
    from pyspark.sql import functions as F

    from slantframe.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, neighbours=20)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text of documents and decodes the ids."""
    import public_tokenizers

    from slantframe.llm.piece_codec import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and similarity 0.85."""
    from slantframe.llm.jaccard import Similarity, jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), Similarity(words=4, num=85, den=100))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds the documents that hold passages of the benchmark."""
    from slantframe.llm.decontaminate import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text of documents; learns from the rows that are not held out."""
    from slantframe.llm.toxicity import fit_toxicity, held_out, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    learn, held = held_out(3, 1)
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), learn)
    return score_toxicity(docs, model, threshold=0.7).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one that quotes the template, and reads the output back."""
    from slantframe.llm.chat import digest_conversations, format_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_conversations(turns.unionByName(more)))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes pages to archives and reads the archives back."""
    from slantframe.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text of documents; learns from the rows that are not held out."""
    from slantframe.llm.quality import fit_quality, score_quality
    from slantframe.llm.toxicity import held_out

    docs = _table(spark, sf_dir, "documents")
    learn, held = held_out(5, 0)
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), learn)
    return score_quality(docs, model, threshold=0.3).select("doc_id", held.alias("held_out"), "score", "predicted")


#: The rules of op9. Where none fits, hosts that track more of their urls than all pages together are blocked.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url by the rules and, where none fits, by a list of hosts read off the corpus."""
    from slantframe.llm.url_filter import Rule, judge_urls, tracked_hosts

    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, [Rule(*r) for r in URL_RULES], tracked_hosts(pages))


#: A domain of the corpus is listed if its first label holds one of these words between hyphens.
BLOCKED_WORDS = ("spam", "pills", "casino", "bets", "xxx", "viagra", "porn", "poker")


def op9_url_filter_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_url_filter, with a list read off the corpus's own hosts that covers subdomains."""
    from slantframe.llm.url_filter import Rule, judge_urls, worded_hosts

    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, [Rule(*r) for r in URL_RULES], worded_hosts(pages, BLOCKED_WORDS), parents=True)


OP9_SQL = """
with rest as (select page_id, url, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
parsed as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
listed as (select host from parsed where host <> '' group by host having sum(coalesce(regexp_matches(url, '[?&]utm_'), false)::int) * (select count(*) from parsed) > count(*) * (select sum(coalesce(regexp_matches(url, '[?&]utm_'), false)::int) from parsed)),
ruled as (select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from parsed)
select page_id, host, path, rule, case
    when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
    when rule is not null then 'allow'
    when host in (select host from listed) then 'block' else 'allow' end as verdict
from ruled
"""

#: A host is blocked if one of its labels holds a word: it is then at or below the domain that starts with that label.
OP9_DOMAINS_SQL = OP9_SQL.replace("host in (select host from listed)", "list_has_any(string_split(replace(host, '.', '-'), '-'), [{words}])")

OP6_SQL = """
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
    select *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\\', '\\\\'), '<(s>|/s>|<SYS>>|</SYS>>|\\|image\\|>|\\|audio\\|>|\\|document\\|>)', '<\\\\\\1', 'g'),
                          '\\[(INST\\]|/INST\\]|ROLE\\]|/ROLE\\])', '[\\\\\\1', 'g'), '^', '') as body from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role) + length(body) + length('<s>[ROLE][/ROLE]</s>'))::bigint as formatted_chars
from escaped group by conv_id
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every repeated 200-byte string from all documents."""
    from slantframe.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the style trees of the hosts."""
    from slantframe.llm.html_main import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


#: These pages mark their articles, which hold headings, paragraphs, bold type and line ends only.
OP11_SQL = r"""
with parts as (
    select page_id, url, list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:h1|p)>'),
        lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as parts
    from pages)
select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) as text, length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10))) as n_chars
from parts
"""


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest of docs where every second id (by crc32) has lost the line ends of its text."""
    from pyspark.sql import functions as F

    from slantframe.llm.merkle import manifest

    text = docs["text"]
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, subroots, root and proofs of documents; half of the rows are tampered with before they are checked."""
    out = tampered(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _op12_sql(levels: int = 21) -> str:
    """The manifest with ``levels`` levels at most (3 ** 21 rows a source and as many sources), written out."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join([field("doc_id"), field("source"), field("lang"), field("n_chars"), text]) + ")"
    bits = "flatten(list_transform(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)), lambda b: list_transform(range(8), lambda i: (b >> i) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))), 4294967295)"
    parts = [
        f"""docs as (select doc_id, source, {leaf(field("text"))} as leaf,
            case when {crc} % 2 = 0 then {leaf(field("replace(text, chr(10), '')"))} else {leaf(field("text"))} end as now from documents)""",
        "placed as (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from docs)",
        "a0 as (select tree, idx, leaf as digest, count(*) over (partition by tree) as n from placed)",
        "b0 as (select 0 as tree, tree as idx, digest, count(*) over () as n from a{})".format(levels),
    ]
    ups = {"a": [], "b": []}
    for t in ups:
        for k in range(levels):
            ups[t].append(f"{t}{k + 1} as (select tree, idx // 3 as idx, case when min(n) = 1 then min(digest) else sha256(string_agg(digest, '' order by idx)) end as digest, (min(n) + 2) // 3 as n from {t}{k} group by tree, idx // 3)")
    folds = ["f0 as (select p.doc_id, p.leaf, s.digest as subroot, r.digest as root, p.tree, p.idx, '' as proof, p.now as folded from placed p join b0 s on s.idx = p.tree cross join b{} r)".format(levels)]
    n = 0
    for t in ups:
        for k in range(levels):
            parent = "idx // 3" if k or t == "a" else "tree // 3"
            own = "idx" if k or t == "a" else "tree"
            group = "tree" if t == "a" else "0"
            folds.append(
                f"""f{n + 1} as (select f.* exclude (idx, proof, folded), f.{own} // 3 as idx, proof || x.l || x.r as proof,
                case when x.alone then folded else sha256(x.l || folded || x.r) end as folded from f{n} f join (
                select y.tree, y.idx, y.n = 1 as alone, coalesce(string_agg(z.digest, '' order by z.idx) filter (z.idx < y.idx), '') as l, coalesce(string_agg(z.digest, '' order by z.idx) filter (z.idx > y.idx), '') as r
                from {t}{k} y join {t}{k} z on y.tree = z.tree and y.idx // 3 = z.idx // 3 group by y.tree, y.idx, y.n) x on x.tree = f.{group} and x.idx = f.{own})""".replace("f.0 ", "0 ")
            )
            n += 1
    return "with " + ", ".join([*parts[:3], *ups["a"], parts[3], *ups["b"], *folds]) + f" select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from f{n}"


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of every text of documents under two tokenizers, and its links' counts in the whole table."""
    import public_tokenizers

    from slantframe.llm.alignment import align_documents

    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_decontaminate": op4_decontaminate,
        "op5_toxicity": op5_toxicity,
        "op6_chat_format": op6_chat_format,
        "op7_warc": op7_warc,
        "op8_quality": op8_quality,
        "op9_url_filter": op9_url_filter,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op9_url_filter_domains": op9_url_filter_domains,
        "op11_html": op11_html,
        "op12_merkle": op12_merkle,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_chat_format": OP6_SQL,
        "op9_url_filter": OP9_SQL,
        "op9_url_filter_domains": OP9_DOMAINS_SQL.format(words=", ".join(f"'{w}'" for w in BLOCKED_WORDS)),
        "op11_html": OP11_SQL,
        "op12_merkle": _op12_sql(),
    }
