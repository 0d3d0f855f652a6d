"""Files for spreadsheets and manual mapping: byte order mark, quoting, long candidate lists."""

import json

from pyspark.sql import functions as F

from offerlens.operators import collection as col
from offerlens.operators import portfolio

RESULT = ("payload_id long, position int, id string, card_number string, card_name string, variant_id string, variant_type string, count long, status string, "
          "reason string, group_kind string, expected_sig string, hash string, expected array<string>")


def made(spark, many):
    rows = [(1, 0, 'a"::v', "A", 'say "x"', "v", "normal", 2, "unmatched", "variant-unconfirmed", "number", "", None, []),
            (1, 1, "b::v", "B", "", "v", "normal", 1, "ambiguous", "card-number-multiple", "number", "", None, []),
            (1, 2, "c::v", "C", "none", "v", "normal", 1, "unmatched", "card-number-not-found", "number", "", None, []),
            (0, 0, "b::w", "B", "", "w", "normal", 1, "matched", None, "", "", None, [])]
    few = spark.createDataFrame([(7, "k,7", "A", ["t"], "t", "na\"me", ""), (3, 'k"3', "A", [], "", "n", "M-3")],
                                "entry_id long, price_key string, card_number string, tags array<string>, tag_sig string, name string, model_no string")
    hot = spark.range(10, 10 + many).select(F.col("id").alias("entry_id"), F.concat(F.lit("p"), "id").alias("price_key"), F.lit("B").alias("card_number"),
                                            F.array().cast("array<string>").alias("tags"), F.lit("").alias("tag_sig"), F.lit("n").alias("name"), F.lit("m").alias("model_no"))
    return spark.createDataFrame(rows, RESULT), (few.unionByName(hot), None, spark.createDataFrame([], "entry_id long, hash string"))


def part_bytes(path):
    return [p.read_bytes() for p in sorted(path.glob("part-*")) if p.stat().st_size]


def test_unresolved_csv_streams_long_candidate_lists(spark, tmp_path):
    results, index = made(spark, 200_000)
    col.write_unresolved_files(results, index, str(tmp_path / "c"))
    assert all(b.startswith(b'\xef\xbb\xbf"cardNumber","cardName",') for b in part_bytes(tmp_path / "c"))
    rows = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').orderBy("cardNumber").collect()
    assert [(r["cardNumber"], r["cardName"], r["count"], r["status"]) for r in rows] == [("A", 'say "x"', "2", "unmatched"), ("B", None, "1", "ambiguous"), ("C", "none", "1", "unmatched")]
    assert rows[0]["candidateKeys"] == 'k"3|k,7' and rows[2]["candidateKeys"] is None
    assert rows[1]["candidateKeys"] == "|".join(f"p{k}" for k in range(10, 200_010))


def test_unresolved_json_has_manual_mapping_options(spark, tmp_path):
    results, index = made(spark, 3)
    col.write_unresolved_files(results, index, str(tmp_path / "j"), fmt="json")
    items = [json.loads(line) for b in part_bytes(tmp_path / "j") for line in b.decode().split("\n") if line]
    assert [i["cardNumber"] for i in items] == ["B", "A", "C"]
    by = {i["cardNumber"]: i for i in items}
    assert by["A"]["candidates"] == [{"priceKey": 'k"3', "name": "n", "modelNo": "M-3", "tags": []}, {"priceKey": "k,7", "name": 'na"me', "modelNo": "A", "tags": ["t"]}]
    assert by["A"]["manualMappingKey"] == 'a"::v' and by["A"]["manualMappingOptions"] == [{"priceKey": k, "confirmedBy": "manual"} for k in ('k"3', "k,7")]
    assert by["A"]["cardName"] == 'say "x"' and by["C"]["candidates"] == [] == by["C"]["manualMappingOptions"]
    assert [c["priceKey"] for c in by["B"]["candidates"]] == ["p10", "p11", "p12"] and by["B"]["matchStatus"] == "ambiguous"


def test_every_holdings_file_starts_with_mark_and_header(spark, tmp_path):
    rows = spark.range(40, numPartitions=3).select(F.lit("o").alias("owner_id"), F.concat(F.lit('n "'), "id").alias("name"), F.lit("m").alias("model_no"),
                                                   F.lit(1).alias("price"), F.col("id").alias("qty"), F.col("id").alias("subtotal"), F.lit("").alias("image_url"))
    portfolio.write_holdings_csv(rows, str(tmp_path / "h"))
    parts = part_bytes(tmp_path / "h")
    assert len(parts) == 3 and all(b.startswith(b'\xef\xbb\xbf"owner_id","name",') and b.count(b'"owner_id"') == 1 for b in parts)
    back = portfolio.import_holdings(portfolio.read_holdings_csv(spark, str(tmp_path / "h"))).collect()
    assert {(r["entity_key"], r["qty"]) for r in back if r["qty"]} == {(f'n "{k}_m', k) for k in range(1, 40)}
