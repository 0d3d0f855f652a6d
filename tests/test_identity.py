import pytest

from offerlens.operators.identity import IdentityRules, TagInteraction, TokenRule, parse_identities

RULES = IdentityRules(
    tokens=(
        TokenRule("英語版箔押し", ("en-foil",)),
        TokenRule("英語(?:版)?", ("en",)),
        TokenRule("箔押し", ("foil",)),
        TokenRule(r"(?i)vol(\d)", ("vol$1",)),
        TokenRule("^秘$", ("~hidden",)),
    ),
    interactions=(
        TagInteraction(if_all=("~hidden", "~rarity"), add=("hidden",)),
        TagInteraction(drop=("~hidden",)),
        TagInteraction(if_any=("vol1", "vol2"), drop=("foil",), drop_pattern="^illust:"),
    ),
    rarity_pattern="(?i)^(?:r|sr)$",
    noise_patterns=("^[赤青]{1,2}$", r"^20\d{2}$"),
    illustrator_pattern=r"(?i)^illust[:：]\s*(.+)$",
    trailing_phrases=("未使用", r"for\s*all"),
    leading_pattern=r"^([^\s【《(（]{2,12}版)(?=[ぁ-んァ-ヶ一-龠a-zA-Z])",
    redundant_tags=(("ST", "^入門"),),
)


def keys(spark, rows):
    df = spark.createDataFrame([(str(k), n, m) for k, (n, m) in enumerate(rows)], "id string, name string, model_no string")
    return [r.asDict() for r in parse_identities(df, RULES).orderBy(df.id.cast("int")).collect()]


def test_spellings_of_one_product_share_a_key(spark):
    rows = [
        ("ねこ【英語版】【赤】", "OP01-001"),
        ("ねこ（英語）（Ｒ）", "ＯＰ０１－００１".replace("－", "-")),
        ("《赤》ねこ OP01-001 [英語/R/2024]", "型番：英語"),
        ("ねこ&#12304;英語&#x3011;", "op01-001"),
    ]
    assert {r["identity_key"] for r in keys(spark, rows)} == {"op01-001@en"}


@pytest.mark.parametrize("name, model, tags", [
    ("ねこ【英語版箔押し】", "OP01-001", ["en-foil"]),  # the longer rule consumes the text first
    ("ねこ【英語版 箔押し】", "OP01-001", ["en", "foil"]),
    ("ねこ【青の背景】", "OP01-001", ["青の背景"]),  # unknown tokens stay as tags
    ("ねこ【英語・Vol２】", "OP01-001", ["en", "vol2"]),
    ("ねこ【箔押し】【vol1】【illust: Ann】", "OP01-001", ["vol1"]),
    ("ねこ【Illust：Ann B.】", "OP01-001", ["illust:annb"]),
    ("ねこ【秘】", "OP01-001", []),
    ("ねこ【秘】【SR】", "OP01-001", ["hidden"]),
    ("ねこ 未使用 ※箱付き for all", "OP01-001", ["未使用", "箱付きforall"]),  # the sign takes all that follows
    ("ねこ for all 未使用", "OP01-001", ["forall", "未使用"]),
    ("特別版ねこ", "OP01-001", ["特別"]),
    ("ねこ【入門セット】", "ST01-001", []),
    ("ねこ【入門セット】", "OP01-001", ["入門セット"]),
])
def test_tags(spark, name, model, tags):
    assert sorted(keys(spark, [(name, model)])[0]["tags"]) == sorted(tags)


def test_last_code_of_model_then_name_and_nameless_key(spark):
    got = keys(spark, [("ねこ OP02-002", "OP01-001 / EB01-003"), ("ねこ P-001 OP02-002", ""), ("ド ン！！ー", ""), (None, None)])
    assert [r["model_code"] for r in got] == ["EB01-003", "OP02-002", "", ""]
    assert got[2]["identity_key"] == "name:ドン"
    assert got[3]["identity_key"] == "name:"
    assert got[0]["base_name"] == "ねこ"
