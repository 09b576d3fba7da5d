"""Label understanding."""

from factsieve.operators.labels import preview_labels, spec_rows, parse_labels


def specs_of(spark, labels):
    return {s.label: s for s in spec_rows(spark, labels)}


def test_known_labels(spark):
    cases = [
        ("Hotel Name", "name", False), ("Phone Number", "phone", False), ("Email", "email", False),
        ("Website", "url", False), ("Description", "description", False), ("Address", "address", False),
        ("Price", "price", False), ("Main Image", "image", False), ("Gallery Images", "image_list", True),
        ("Amenities", "list", True), ("Opening Hours", "hours", False), ("Latitude", "latitude", False),
        ("Longitude", "longitude", False), ("Facebook", "social", False), ("Instagram", "social", False),
        ("CEO Name", "name", False), ("Phone", "phone", False), ("Tel", "phone", False),
        ("Contact Number", "phone", False), ("Photos", "image_list", True), ("Photo Gallery", "image_list", True),
        ("Menu Image", "image", False), ("Menu Images", "image_list", True), ("Warranty Period", "date", False),
        ("Delivery Fee", "price", False), ("Support Email", "email", False), ("Head Chef", "name", False),
        ("Flurb Rating Index", "rating", False), ("Zibble", "text", False), ("Rates", "price", True),
        ("Facebook Link", "social", False), ("WhatsApp", "phone", False), ("Room Type", "list", True),
    ]
    got = specs_of(spark, [c[0] for c in cases])
    assert {k: (s.type, s.plural) for k, s in got.items()} == {c[0]: (c[1], c[2]) for c in cases}
    assert got["Facebook Link"].social == "facebook"
    assert "menu" in got["Menu Image"].keywords and got["Menu Image"].key == "menu_image"
    assert got["CEO Name"].exclusive and got["CEO Name"].label_keywords == ["ceo", "name"]
    assert got["WhatsApp"].narrow == ["whatsapp"]
    assert got["Phone Number"].match_score == 1.0


def test_blanks_and_duplicates(spark):
    got = spec_rows(spark, ["Phone Number", "phone number", "", "   ", "Email"])
    assert [s.key for s in got] == ["phone_number", "email"]


def test_preview(spark):
    labels = spark.createDataFrame([(0, "Phone Number"), (1, "Zibble")], "pos int, label string")
    got = preview_labels(parse_labels(labels), 40, 8).collect()
    assert [(r.label, r.matched, len(r.keywords)) for r in got] == [("Phone Number", "phone", 8), ("Zibble", None, 1)]
    assert [len(r.keywords) for r in preview_labels(parse_labels(labels)).collect()] == [13, 1]
