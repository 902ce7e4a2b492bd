from tests.conftest import at

from gavel.operators.validate import validate_listings, validate_logins, validate_registrations
from gavel.schemas import LISTING_FEED, LOGIN_FEED, REGISTRATION_FEED

NOW = at(0)
DAY = 86_400_000


def iso(ms):
    return at(ms).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


GOOD = dict(title=" Ring ", description="gold", category="Diamonds", imageUrl="https://a.example/1.jpg",
            startingPrice="500", endTime=iso(DAY))


def listing_errors(spark, **changes):
    row = {**GOOD, **changes}
    feed = spark.createDataFrame([(1, 7, *row.values())], LISTING_FEED)
    valid, rejected = validate_listings(feed, NOW)
    found = rejected.collect()
    if found:
        assert valid.count() == 0 and found[0].first_error == found[0].errors[0]
        return found[0].errors
    return valid.collect()[0]


def test_a_good_listing_is_normalised(spark):
    row = listing_errors(spark)
    assert (row.title, row.starting_price, row.seller_id) == ("Ring", 500, 7)


def test_every_listing_message(spark):
    price_range = "Starting bid must be between ₹1 and ₹10,00,00,000."
    whole = "Starting bid must be a whole number of rupees."
    url = "Photo URL must start with http:// or https://"
    cases = [
        (dict(title="  "), "Item title is required."), (dict(title=None), "Item title is required."),
        (dict(title="x" * 121), "Title must be under 120 characters."),
        (dict(title="😀" * 60 + "x"), "Title must be under 120 characters."),
        (dict(description=""), "Description is required."),
        (dict(description="x" * 1001), "Description must be under 1000 characters."),
        (dict(category="Watches"), "Choose a category from the list."),
        (dict(imageUrl=""), "Photo URL is required."),
        (dict(imageUrl="https://a.example/" + "x" * 500), "Photo URL is required."),
        (dict(imageUrl="javascript:alert(1)"), url), (dict(imageUrl="/images/a.jpg"), url),
        (dict(startingPrice="abc"), whole), (dict(startingPrice="1.5"), whole),
        (dict(startingPrice=""), price_range), (dict(startingPrice="0"), price_range),
        (dict(startingPrice="100000001"), price_range),
        (dict(endTime=""), "Choose when the auction ends."),
        (dict(endTime="soon"), "Choose when the auction ends."),
        (dict(endTime=iso(299_999)), "End time must be at least 5 minutes from now."),
        (dict(endTime=iso(30 * DAY + 1)), "Auctions can run for at most 30 days."),
    ]
    for changes, message in cases:
        assert listing_errors(spark, **changes) == [message], changes


def test_listing_limits_are_inclusive(spark):
    for changes in (dict(title="x" * 120), dict(title="😀" * 60), dict(description="x" * 1000),
                    dict(startingPrice="1"), dict(startingPrice="100000000"), dict(startingPrice="1e3"),
                    dict(endTime=iso(300_000)), dict(endTime=iso(30 * DAY)),
                    dict(imageUrl="https://a.example/" + "x" * 482)):
        assert listing_errors(spark, **changes).seller_id == 7, changes


def test_listing_errors_keep_their_order(spark):
    errors = listing_errors(spark, title="", description="", category="", imageUrl="", startingPrice="x",
                            endTime="")
    assert errors == ["Item title is required.", "Description is required.",
                      "Choose a category from the list.", "Photo URL is required.",
                      "Starting bid must be a whole number of rupees.", "Choose when the auction ends."]


PERSON = dict(firstName="A", lastName="B", email=" A@B.co ", phone="1", password="12345678",
              confirmPassword="12345678", seller=None)


def test_every_registration_message(spark):
    cases = [
        (dict(firstName=" "), ["First name and last name are required."]),
        (dict(lastName="x" * 101), ["Name is too long."]),
        (dict(email="a@b"), ["Enter a valid email address."]),
        (dict(email="a b@c.d"), ["Enter a valid email address."]),
        (dict(email="a@b@c.d"), ["Enter a valid email address."]),
        (dict(phone=None), ["Phone number is required."]),
        (dict(password="1234567", confirmPassword="1234567"),
         ["Password must be at least 8 characters."]),
        (dict(confirmPassword="12345679"), ["Passwords do not match."]),
        (dict(firstName=None, phone="", password=None, confirmPassword="x"),
         ["First name and last name are required.", "Phone number is required.",
          "Password must be at least 8 characters.", "Passwords do not match."]),
    ]
    rows = [(i, *{**PERSON, **c}.values()) for i, (c, _) in enumerate(cases)]
    _, rejected = validate_registrations(spark.createDataFrame(rows, REGISTRATION_FEED))
    assert {r.feed_id: r.errors for r in rejected.collect()} == {
        i: errors for i, (_, errors) in enumerate(cases)}
    assert "password" not in rejected.columns


def test_registration_roles_and_email(spark):
    rows = [(i, *{**PERSON, "seller": s}.values()) for i, s in enumerate(["on", "", None, "false"])]
    valid, _ = validate_registrations(spark.createDataFrame(rows, REGISTRATION_FEED))
    got = {r.feed_id: (r.role, r.email) for r in valid.collect()}
    assert got == {0: ("seller", "a@b.co"), 1: ("buyer", "a@b.co"), 2: ("buyer", "a@b.co"),
                   3: ("seller", "a@b.co")}


def test_logins_need_both_fields(spark):
    rows = [(0, " A@b ", "x"), (1, " ", "x"), (2, "a", ""), (3, None, None), (4, "a", " ")]
    valid, rejected = validate_logins(spark.createDataFrame(rows, LOGIN_FEED))
    assert {r.feed_id: r.email for r in valid.collect()} == {0: "a@b", 4: "a"}
    assert {r.feed_id: r.errors for r in rejected.collect()} == {
        i: ["Enter your email and password."] for i in (1, 2, 3)}
