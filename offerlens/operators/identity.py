"""Listing identity: product code and variant tags read from noisy names, by user-supplied rules.

The vocabulary is data: an IdentityRules value holds the ordered token rules, the noise
patterns and the tag interactions. Patterns are Java regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import CODE_PATTERN, constant_rows, last_code
from offerlens.functions.skew import spread_join
from offerlens.functions.unicode import nfkc_decoded

# Bracket pairs whose contents are tokens, token separators, and the signs
# that make no difference between two unknown tokens.
BRACKETS = r"【[^】]*】|《[^》]*》|\([^)]*\)|（[^）]*）|\[[^\]]*\]|『[^』]*』|「[^」]*」"
TOKEN_SEPARATORS = "[/・,、]"
UNKNOWN_SIGNS = r"(?U)[\s.\-–—_'’!?！？☆★※。、,，:：&()（）『』「」・]+"
UNKNOWN_AFFIXES = "^版|(?:版|仕様)$"
LONG_VOWEL = "ー"

RARITY_MARK = "~rarity"
NO_TAGS = "array<string>"


@dataclass(frozen=True)
class TokenRule:
    """First match of `pattern` in a token is consumed and yields `tags`; '$1' stands for group 1."""

    pattern: str
    tags: tuple[str, ...]


@dataclass(frozen=True)
class TagInteraction:
    """If all of `if_all` and any of `if_any` are present: add tags, then drop tags and pattern matches."""

    if_all: tuple[str, ...] = ()
    if_any: tuple[str, ...] = ()
    add: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    drop_pattern: str = ""


@dataclass(frozen=True)
class IdentityRules:
    tokens: tuple[TokenRule, ...] = ()
    interactions: tuple[TagInteraction, ...] = ()
    rarity_pattern: str = ""
    noise_patterns: tuple[str, ...] = ()
    illustrator_pattern: str = ""
    trailing_phrases: tuple[str, ...] = ()
    leading_pattern: str = ""
    # (code prefix, tag pattern): such tags say nothing for codes with that prefix.
    redundant_tags: tuple[tuple[str, str], ...] = ()
    code_pattern: str = CODE_PATTERN
    model_prefix: str = r"^型(?:番)?[:：\s]*"
    marks: tuple[str, ...] = field(default=(RARITY_MARK,))


def plain_token(c: Column) -> Column:
    """Comparison form of an unknown token: lower case without spaces, signs and affixes."""
    bare = F.regexp_replace(F.lower(c), UNKNOWN_SIGNS, "")
    # ASCII letters and digits hold none of these: most tokens need no pattern of Unicode classes.
    return F.when(~c.rlike("[^A-Za-z0-9]"), F.lower(c)).otherwise(
        F.regexp_replace(F.replace(bare, F.lit(LONG_VOWEL), F.lit("")), UNKNOWN_AFFIXES, ""))


def _with_group(pattern: str) -> str:
    """The pattern with at least one capturing group, so that group 1 can always be asked for."""
    return pattern if re.search(r"(?<!\\)\((?!\?)", pattern) else pattern + "()"


def _token_tags(tokens: Column, rules: IdentityRules) -> Column:
    """Tags per token: known ones by the rules in order, then what is left as an unknown tag.

    The nested transforms bind intermediate values, so the rule fold runs once per token.
    """
    none = F.array().cast(NO_TAGS)
    table = constant_rows([{"pattern": _with_group(r.pattern), "tags": list(r.tags)} for r in rules.tokens], "pattern string, tags array<string>")

    def step(state: Column, rule: Column) -> Column:
        rest, pattern = state["rest"], rule["pattern"]
        at, found = F.regexp_instr(rest, pattern), F.call_function("regexp_extract", rest, pattern, F.lit(0))
        left = F.trim(F.concat(F.substring(rest, F.lit(1), at - 1), F.lit(" "), F.substring(rest, at + F.length(found), F.length(rest))))
        tags = F.transform(rule["tags"], lambda t: F.replace(t, F.lit("$1"), F.call_function("regexp_extract", rest, pattern, F.lit(1))))
        return F.when(F.rlike(rest, pattern), F.struct(left.alias("rest"), F.array_union(state["tags"], tags).alias("tags"))).otherwise(state)

    def consumed(token: Column) -> Column:
        start = F.struct(token.alias("rest"), none.alias("tags"))
        state = start
        if rules.tokens:
            # A constant pattern is compiled once, one from the table per token: most tokens match no rule and skip the fold.
            known = F.array_contains(F.array(*[token.rlike(r.pattern) for r in rules.tokens]), True)
            state = F.when(F.coalesce(known, F.lit(False)), F.aggregate(table, start, step)).otherwise(start)
        return F.struct(token.alias("token"), state.alias("state"))

    def leftover(x: Column) -> Column:
        return F.struct(x["token"].alias("token"), x["state"]["tags"].alias("tags"), plain_token(x["state"]["rest"]).alias("left"))

    def result(x: Column) -> Column:
        token = x["token"]
        out = F.when(token == "", none)
        if rules.rarity_pattern:
            out = out.when(token.rlike(rules.rarity_pattern), F.array(F.lit(RARITY_MARK)))
        if rules.noise_patterns:
            out = out.when(token.rlike("|".join(f"(?:{p})" for p in rules.noise_patterns)), none)
        if rules.illustrator_pattern:
            out = out.when(token.rlike(rules.illustrator_pattern), F.array(
                F.concat(F.lit("illust:"), plain_token(F.regexp_extract(token, rules.illustrator_pattern, 1)))))
        return out.when(F.length(x["left"]) >= 2, F.array_union(x["tags"], F.array(x["left"]))).otherwise(x["tags"])

    return F.transform(F.transform(F.transform(tokens, consumed), leftover), result)


def apply_tag_interactions(tags: Column, interactions) -> Column:
    """Tag set after the interactions in order, sorted. One fold over a constant table, any number of rules."""
    if not interactions:
        return F.array_sort(tags)
    table = constant_rows(
        [{"if_all": list(r.if_all), "if_any": list(r.if_any), "add": list(r.add), "drop": list(r.drop), "drop_pattern": r.drop_pattern or "(?!)"}
         for r in interactions],
        "if_all array<string>, if_any array<string>, add array<string>, drop array<string>, drop_pattern string")

    def step(state: Column, rule: Column) -> Column:
        applies = (F.size(F.array_except(rule["if_all"], state)) == 0) & (
            (F.size(rule["if_any"]) == 0) | F.arrays_overlap(rule["if_any"], state))
        changed = F.filter(F.array_except(F.array_union(state, rule["add"]), rule["drop"]), lambda t: ~F.rlike(t, rule["drop_pattern"]))
        return F.when(applies, changed).otherwise(state)

    return F.array_sort(F.aggregate(table, tags, step))


def parse_identities(names: DataFrame, rules: IdentityRules) -> DataFrame:
    """Identity of each (name, model_no) row: adds model_code, base_name, tags, identity_key."""
    code = f"(?i)(?:{rules.code_pattern})"
    phrases = "|".join(f"(?:{p})" for p in ("※[^※]*", *rules.trailing_phrases))
    trimmed = r"(?U)^\s+|\s+$"
    folded = names.withColumns({"_n": nfkc_decoded(F.col("name")), "_m": F.regexp_replace(nfkc_decoded(F.col("model_no")), rules.model_prefix, "")})
    split = folded.withColumns({
        "model_code": F.coalesce(last_code(F.col("_m"), rules.code_pattern), last_code(F.col("_n"), rules.code_pattern), F.lit("")),
        "_m": F.regexp_replace("_m", code, " "),
        "_n": F.regexp_replace("_n", code, " "),
    }).withColumn(
        "_outside", F.regexp_replace(F.regexp_replace(F.regexp_replace("_n", BRACKETS, " "), r"(?U)\s+", " "), trimmed, "")
    ).withColumn("_tail", F.regexp_extract("_outside", rf"(?U)(?:(?:{phrases})\s*)+$", 0)
    ).withColumn("_base", F.trim(F.expr("substring(_outside, 1, length(_outside) - length(_tail))")))
    lead = F.regexp_extract("_base", rules.leading_pattern, 1) if rules.leading_pattern else F.lit("")
    split = split.withColumn("_lead", lead).withColumn("base_name", F.trim(F.expr("substring(_base, length(_lead) + 1, length(_base))")))

    inside = F.flatten(F.transform(
        F.concat(F.regexp_extract_all("_m", F.lit(f"({BRACKETS})")), F.regexp_extract_all("_n", F.lit(f"({BRACKETS})"))),
        lambda b: F.split(F.substring(b, F.lit(2), F.length(b) - 2), TOKEN_SEPARATORS)))
    tail = F.transform(F.regexp_extract_all("_tail", F.lit(f"({phrases})")), lambda t: F.regexp_replace(t, "^※", ""))
    tokens = F.concat(inside, F.split(F.regexp_replace("_m", BRACKETS, " "), "※"), tail, F.array("_lead"))
    # An empty token, such as what a bare code leaves behind, yields no tag.
    cleaned = F.filter(F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, code, " "), trimmed, "")), lambda t: ~t.eqNullSafe(""))
    tags = F.array_distinct(F.flatten(_token_tags(cleaned, rules)))
    tags = F.filter(apply_tag_interactions(tags, rules.interactions), lambda t: ~t.isin(*rules.marks))
    for prefix, pattern in rules.redundant_tags:
        tags = F.when(F.col("model_code").startswith(prefix), F.filter(tags, lambda t: ~t.rlike(pattern))).otherwise(tags)
    keyed = split.withColumn("tags", tags)
    suffix = F.when(F.size("tags") > 0, F.concat(F.lit("@"), F.array_join("tags", "+"))).otherwise("")
    return keyed.withColumn(
        "identity_key",
        F.when(F.col("model_code") != "", F.concat(F.lower("model_code"), suffix)).otherwise(F.concat(F.lit("name:"), plain_token(F.col("base_name")), suffix)),
    ).drop("_n", "_m", "_outside", "_tail", "_base", "_lead")


def parse_spellings(names: DataFrame, rules: IdentityRules) -> DataFrame:
    """Identity of each distinct (name, model_no).

    A fixed partition count keeps the parsing spread although the spellings are few bytes. The columns are in another order than those of the
    grouping before, as Spark leaves out a repartitioning like the one that it has and then merges the small partitions.
    """
    width = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), names.sparkSession.sparkContext.defaultParallelism)
    return parse_identities(names.select("name", "model_no").distinct().repartition(width, "model_no", "name"), rules)


def resolve_identity(listings: DataFrame, rules: IdentityRules) -> DataFrame:
    """Listings with their identity; each spelling is parsed once, then joined back to its listings."""
    named = _spelled(listings)
    return spread_join(named, parse_spellings(named, rules), ["name", "model_no"])


def resolve_each(records: DataFrame, rules: IdentityRules) -> DataFrame:
    """As `resolve_identity`, for tables of one record per item or offer, whose spellings seldom repeat: each record is parsed where it is.

    Records go through one shuffle, by all that they hold, instead of the four that gather the spellings and join them back: no spelling is
    hot, and the parsing is spread over a few tasks per core whatever the files are.
    """
    named = _spelled(records)
    dealt = [c for c, kind in named.dtypes if not any(k in kind for k in ("map<", "variant"))]
    return parse_identities(named.repartition(4 * named.sparkSession.sparkContext.defaultParallelism, *dealt), rules)


def _spelled(listings: DataFrame) -> DataFrame:
    return listings.withColumns({"name": F.coalesce("name", F.lit("")), "model_no": F.coalesce("model_no", F.lit(""))})
