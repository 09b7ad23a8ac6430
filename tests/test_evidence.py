"""Items of pages routed to fields, and what they say of them."""

from pyspark.sql import functions as F

from sluicework.operators import evidence

SHAPE = "id int, place int, kind string, label string, content string, certainty double, structure string"
ITEMS = [
    (1, 0, "title", "", "1. Seed Fund | Agency of Trade", 0.95, "single_program_page"),
    (1, 1, "section", "Repayment terms", "Repayable over 12 to 36 months after a grace period of 6 months, monthly repayments.", 0.88, "single_program_page"),
    (1, 2, "section", "Documents", "A certificate is needed. Bring a friend.", 0.88, "single_program_page"),
    (1, 3, "section", "How to apply", "Ask in person.", 0.6, "single_program_page"),
    (1, 4, "body", "", "Call us on 011 555 0100 or mail a@x.org", 0.6, "single_program_page"),
    (1, 5, "section", "x", "nothing", 0.5, "single_program_page"),
    (1, 6, "body", "", "nothing", 0.5, None),
    (1, 7, "body", " ", None, 0.5, None),
    (2, 0, "title", "", "Grants", 0.95, "parent_page"),
    (2, 1, "body", "", "A grant of R5m", 0.6, "parent_page"),
    (2, 2, "section", "One", "A grant of R5m", 0.88, "multi_program_page"),
]


def test_routes_and_fields(spark):
    routed = evidence.routed_items(spark.createDataFrame(ITEMS, SHAPE))
    got = {(r.id, r.place): r.buckets for r in routed.collect()}
    assert got == {
        (1, 0): ["funding"], (1, 1): ["terms"], (1, 2): ["documents"], (1, 3): ["application"], (1, 4): ["contact"], (1, 5): ["program"], (1, 6): ["supporting"],
        (2, 0): ["program"], (2, 1): ["supporting"], (2, 2): ["funding"],
    }
    found = evidence.folded_fields(evidence.field_evidence(routed, F.lit("2026-01-10").cast("date"))).collect()
    one = {r.field: (r.value, round(r.confidence, 2)) for r in found if r.id == 1}
    assert one["program_name"] == ("Seed Fund", 0.95) and one["funder_name"] == ("Agency of Trade", 0.95)
    assert (one["payback_months_min"][0], one["payback_months_max"][0], one["grace_months"][0]) == ("12", "36", "6") and one["payback_structure"][0] == "monthly instalments"
    assert one["required_documents"] == ("A certificate is needed.", 0.88) and one["application_channel"] == ("Manual / Contact first", 0.7)
    assert one["contact_email"] == ("a@x.org", 0.9) and one["contact_phone"][1] == 0.9 and "deadline_date" not in one
    two = {r.field: r.value for r in found if r.id == 2}
    assert float(two["ticket_max"]) == 5e6 and "ticket_min" not in two and two["program_name"] == "Grants"


def test_no_items(spark):
    routed = evidence.routed_items(spark.createDataFrame([], SHAPE))
    assert evidence.field_evidence(routed, F.current_date()).count() == 0


def test_items_are_read_once_before_rows_are_made(spark):
    """Patterns stand in projections, none in the generator that makes the rows."""
    items = spark.createDataFrame([(1, 0, "section", "", "Apply by email: a@b.co or https://b.co/apply/1 today", 0.5, "x")], "id int, place int, kind string, label string, content string, certainty double, structure string")
    found = evidence.field_evidence(evidence.routed_items(items), F.lit("2026-01-10").cast("date"))
    made = [x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if "Generate inline(filter(" in x]
    assert len(made) == 1 and "regexp" not in made[0] and "RLIKE" not in made[0]
    assert {(r.field, r.value) for r in found.collect()} >= {("contact_email", "a@b.co"), ("application_url", "https://b.co/apply/1"), ("application_channel", "Online form")}
