"""Short and long answers are matched alike."""

import json

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import lookup
from tests.test_lookup import ANSWERS, CITES, FIVE, NINE, item


@pytest.mark.parametrize("short", [0, 1 << 14])
@pytest.mark.parametrize("strict", [True, False])
def test_answers_either_way(spark, monkeypatch, short, strict):
    monkeypatch.setattr(lookup, "_SHORT", short)
    asked = [*(x["citation"] for x in FIVE), *(x["citation"] for x in NINE), "104 s. ct. 2052", "248739", None]
    rows = spark.createDataFrame([(d, i, c) for d in (1, 2, 3, 4, None) for i, c in enumerate(asked)], CITES).withColumn("more", F.col("ord") * 2)
    answers = spark.createDataFrame([(1, json.dumps(FIVE)), (2, json.dumps([None, item("d", normalized=[]), *NINE])), (3, "Service unavailable"), (None, json.dumps(FIVE))], ANSWERS)
    got = lookup.match_lookup(rows.union(rows.where("doc_id = 2")), answers, strict, carry=("more",)).collect()
    assert len(got) == 6 * len(asked) and all(r["more"] == 2 * r["ord"] for r in got)
    hits = {(r["doc_id"], r["citation"]): (r["item_ord"], r["stage"], r["case_name"]) for r in got if r["item_ord"] is not None}
    want = {(1, "466 U.S. 668"): (0, 1), (1, "104 S. Ct. 2052"): (0, 2), (1, "998 F.2d 1460"): (2, 1), (1, "977 F.2d 1067"): (3, 1), (1, "104 s. ct. 2052"): (1, 1), (2, "534 F.3d 1290"): (2, 1)}
    if not strict:
        want |= {(1, "2018 WL 4697269"): (4, 1)} | {(2, x["citation"]): (2 + k, 1) for k, x in enumerate(NINE) if k}
    assert {k: v[:2] for k, v in hits.items()} == want
    assert hits[1, "466 U.S. 668"][2] == "Strickland v. Washington"
    assert lookup.match_lookup(rows.drop("more").union(rows.where("doc_id = 2").drop("more")), answers, strict).count() == 5 * len(asked)
