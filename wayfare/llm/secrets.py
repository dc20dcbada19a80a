"""Secret scans with a trigram inverted index, in DataFrame functions alone.

Each rule's regex is turned into a Boolean query over lower-case trigrams. Postings are built for
every trigram that some query names (no other could ever be asked for), intersected per row, and
the surviving candidates verified with the regex. A rule without mandatory trigrams, such as a run
of hex digits, scans all texts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import fresh, text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind; Java regex; branches: for each alternative of the regex the literals it must contain
    (empty: no mandatory literal); group and least: drop matches whose group is shorter."""

    kind: str
    pattern: str
    branches: tuple[tuple[str, ...], ...] = ()
    group: int = 0
    least: int = 0
    base: bool = False


#: Patterns and their mandatory literals. The first three are the base kinds.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        (("password",), ("passwd",), ("secret",), ("token",), ("api_key",), ("apikey",)),
        group=2,
        least=8,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", (("akia",),), base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", (("-----begin ", "private key-----"),)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", (("ghp_",), ("gho_",), ("ghu_",), ("ghs_",), ("ghr_",))),
    Rule("chat", r"xox[baprs]-[0-9A-Za-z-]{10,}", (("xoxb-",), ("xoxa-",), ("xoxp-",), ("xoxr-",), ("xoxs-",))),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ((".eyj", "eyj"),)),
)


#: The rules for masking: pem reaches over the body of the key to its END line, or without one to the end of the base64 lines.
_GAP = r"(?:\s|\\[rn])*+"
_PEM_END = r"[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
_PEM_LINES = rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)*+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/=]++(?=[ \t]*+(?:[\r\n]|\z)))*+"
MASKED = tuple(replace(rule, pattern=f"{rule.pattern}(?:{_PEM_END}|{_PEM_LINES})") if rule.kind == "pem" else rule for rule in RULES)


def trigram_query(rule: Rule) -> list[list[str]]:
    """Disjunction of conjunctions of trigrams; an empty list means a full scan."""
    return [sorted({lit[i : i + 3] for lit in branch for i in range(len(lit) - 2)}) for branch in rule.branches]


def postings(docs: DataFrame, key: list[str], rules=RULES) -> DataFrame:
    """The inverted index: (trigram, *key), one posting for each row that holds the trigram."""
    grams = sorted({g for rule in rules for branch in trigram_query(rule) for g in branch})
    every = F.array(*map(F.lit, grams))
    # the lambda's variable holds the lower-case text, which is so made once a row
    found = F.transform(F.array(F.lower(text_or_empty())), lambda low: F.filter(every, lambda gram: F.contains(low, gram)))
    return docs.select(*key, F.explode(found[0]).alias("trigram"))


def candidates(index: DataFrame, key: list[str], rules=RULES) -> DataFrame:
    """(*key, kinds): rows whose postings satisfy a rule's query. The lists of a conjunction's trigrams
    are intersected by counting, for each row in any of them, in how many it is. A row's postings are at
    most the trigrams of all queries, so no group grows with the data."""
    branches = [(rule.kind, grams) for rule in rules for grams in trigram_query(rule)]
    asking = {g: [i for i, (_, grams) in enumerate(branches) if g in grams] for _, own in branches for g in own}
    by_gram = F.create_map(*[x for g, own in sorted(asking.items()) for x in (F.lit(g), F.array(*map(F.lit, own)))])
    need, kind = F.array(*[F.lit(len(grams)) for _, grams in branches]), F.array(*[F.lit(k) for k, _ in branches])
    branch = fresh(index, "branch")[0]
    posted = index.select(*key, "trigram", F.explode(by_gram[F.col("trigram")]).alias(branch))
    met = posted.groupBy(*key, branch).agg(F.count_distinct("trigram").alias("met")).where(F.col("met") == F.get(need, F.col(branch)))
    return met.groupBy(*key).agg(F.collect_set(F.get(kind, F.col(branch))).alias("kinds"))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the rule's matches, leftmost and non-overlapping:
    the gaps of split() and the matches of regexp_extract_all() alternate."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    steps = F.zip_with(
        F.zip_with(F.split(text, rule.pattern, -1), whole, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))),
        kept,
        lambda pair, part: F.struct(
            F.length(pair["gap"]).alias("gap"), F.length(pair["hit"]).alias("hit"), F.length(part).alias("part")
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,part:int>>")
    walked = F.aggregate(
        F.filter(steps, lambda s: s["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["hit"]).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + s["gap"]).alias("start"),
                        (acc["at"] + s["gap"] + s["hit"]).alias("end"),
                        s["part"].alias("part"),
                    )
                ),
            ).cast("array<struct<start:int,end:int,part:int>>"),
        ),
        lambda acc: acc["spans"],
    )
    if rule.least:
        walked = F.filter(walked, lambda s: s["part"] >= rule.least)
    return F.transform(walked, lambda s: F.struct(s["start"], s["end"]))


def _labelled(rank: int, kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
    )


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs plus secret_spans: array of (start, rank, end, kind), sorted by start, then rule order.

    start and end are code points, end exclusive. Null and empty texts have no spans. Rows alike in
    id and text share one posting list entry and each keep their row; a null id is joined null-safe.
    Extra columns are kept; secret_spans is replaced if it is there. Empty tables give no rows."""
    docs = docs.drop("secret_spans")
    key = fresh(docs, "row_id", "row_hash", "row_size")
    text = text_or_empty()
    keyed = docs.withColumns(
        {
            key[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
            key[1]: F.xxhash64(text),
            key[2]: F.octet_length(text),
        }
    )
    found = candidates(postings(keyed, key, rules), key, rules)
    kinds = fresh(keyed, "kinds")[0]
    joined = keyed.join(found.withColumnRenamed("kinds", kinds), key, "left")
    parts = []
    for rank, rule in enumerate(rules):
        possible = F.array_contains(kinds, rule.kind) if rule.branches else text.rlike(rule.pattern)
        spans = F.transform(rule_spans(text, rule), _labelled(rank, rule.kind))
        parts.append(F.when(possible, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.array_sort(F.concat(*parts)).alias("secret_spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, rules=MASKED, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every span replaced by mask (overlapping spans by one) and n_chars recounted."""
    scanned = scan_secrets(docs, rules)
    text = text_or_empty()
    cut = F.aggregate(
        "secret_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647))),
    )
    clean = F.when(F.size("secret_spans") > 0, cut).otherwise(F.col("text"))
    out = scanned.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
