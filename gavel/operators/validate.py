"""Bulk checks of the three forms: every row is judged, none is lost.

Each check returns (valid, rejected). ``rejected`` keeps the submitted columns
and adds ``errors`` in the order the form reports them, and ``first_error``,
the one the form shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.clock import DAY, MINUTE, as_of_column, parse_zoned
from gavel.functions.money import money_inr
from gavel.functions.text import (EMAIL_PATTERN, computed_once, is_whole, norm_email, norm_text,
                                  safe_image_url, to_number, utf16_length)

# The limits of the forms.
CATEGORIES = ("Women's Jewelry", "Luxury Watches", "Diamonds")
MAX_TITLE, MAX_DESCRIPTION, MAX_IMAGE_URL = 120, 1000, 500
MIN_PRICE, MAX_PRICE = 1, 100_000_000
MIN_DURATION_MS, MAX_DURATION_MS = 5 * MINUTE, 30 * DAY
MAX_NAME, MIN_PASSWORD = 100, 8


def _judge(feed: DataFrame, checks: list[Column]) -> DataFrame:
    return computed_once(feed, errors=F.array_compact(F.array(*checks)))


def _split(judged: DataFrame, submitted: list[str]) -> tuple[DataFrame, DataFrame]:
    valid = judged.where(F.size("errors") == 0).drop("errors")
    rejected = judged.where(F.size("errors") > 0).select(
        *submitted, "errors", F.col("errors")[0].alias("first_error"))
    return valid, rejected


def judge_listings(feed: DataFrame, as_of: Column | str) -> DataFrame:
    """Listing forms with normalised ``n_*`` columns and ``errors``."""
    price, end_text = to_number(F.col("startingPrice")), norm_text(F.col("endTime"))
    rows = computed_once(
        feed,
        n_title=norm_text(F.col("title")),
        n_description=norm_text(F.col("description")),
        n_category=norm_text(F.col("category")),
        n_image_url=norm_text(F.col("imageUrl")),
        n_price=price,
        n_end=parse_zoned(end_text))

    def text_check(name: str, label: str, required: str, limit: int) -> Column:
        return F.when(F.col(name) == "", required).when(
            utf16_length(F.col(name)) > limit, f"{label} must be under {limit} characters.")

    left = F.unix_millis("n_end") - F.unix_millis(as_of_column(as_of))
    no_url = (F.col("n_image_url") == "") | (utf16_length(F.col("n_image_url")) > MAX_IMAGE_URL)
    out_of_range = (F.col("n_price") < MIN_PRICE) | (F.col("n_price") > MAX_PRICE)
    return _judge(rows, [
        text_check("n_title", "Title", "Item title is required.", MAX_TITLE),
        text_check("n_description", "Description", "Description is required.", MAX_DESCRIPTION),
        F.when(~F.col("n_category").isin(*CATEGORIES), "Choose a category from the list."),
        F.when(no_url, "Photo URL is required.").when(
            ~safe_image_url(F.col("n_image_url")),
            "Photo URL must start with http:// or https://"),
        F.when(~is_whole(F.col("n_price")), "Starting bid must be a whole number of rupees.")
        .when(out_of_range, F.concat(
            F.lit(f"Starting bid must be between ₹{MIN_PRICE} and "),
            money_inr(F.lit(MAX_PRICE)), F.lit("."))),
        F.when(F.col("n_end").isNull(), "Choose when the auction ends.")
        .when(left < MIN_DURATION_MS, "End time must be at least 5 minutes from now.")
        .when(left > MAX_DURATION_MS, "Auctions can run for at most 30 days."),
    ])


def validate_listings(feed: DataFrame, as_of: Column | str) -> tuple[DataFrame, DataFrame]:
    valid, rejected = _split(judge_listings(feed, as_of), feed.columns)
    return valid.select(
        "feed_id", "seller_id", F.col("n_title").alias("title"),
        F.col("n_description").alias("description"), F.col("n_category").alias("category"),
        F.col("n_image_url").alias("image_url"),
        F.col("n_price").cast("long").alias("starting_price"),
        F.col("n_end").alias("end_time")), rejected


def judge_registrations(feed: DataFrame) -> DataFrame:
    """Registration forms with normalised ``n_*`` columns and ``errors``."""
    password = F.coalesce("password", F.lit(""))
    rows = computed_once(
        feed,
        n_first=norm_text(F.col("firstName")),
        n_last=norm_text(F.col("lastName")),
        n_email=norm_email(F.col("email")),
        n_phone=norm_text(F.col("phone")),
        n_role=F.when(F.coalesce("seller", F.lit("")) != "", "seller").otherwise("buyer"))
    too_long = (utf16_length(F.col("n_first")) > MAX_NAME) | (
        utf16_length(F.col("n_last")) > MAX_NAME)
    return _judge(rows, [
        F.when((F.col("n_first") == "") | (F.col("n_last") == ""),
               "First name and last name are required."),
        F.when(too_long, "Name is too long."),
        F.when(~F.col("n_email").rlike(EMAIL_PATTERN), "Enter a valid email address."),
        F.when(F.col("n_phone") == "", "Phone number is required."),
        F.when(utf16_length(password) < MIN_PASSWORD,
               f"Password must be at least {MIN_PASSWORD} characters."),
        F.when(password != F.coalesce("confirmPassword", F.lit("")), "Passwords do not match."),
    ])


def validate_registrations(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid side carries no password: nothing downstream stores one."""
    valid, rejected = _split(judge_registrations(feed), feed.columns)
    return valid.select(
        "feed_id", F.col("n_first").alias("first_name"), F.col("n_last").alias("last_name"),
        F.col("n_email").alias("email"), F.col("n_phone").alias("phone"),
        F.col("n_role").alias("role")), rejected.drop("password", "confirmPassword")


def judge_logins(feed: DataFrame) -> DataFrame:
    rows = feed.withColumn("n_email", norm_email(F.col("email")))
    empty = (F.col("n_email") == "") | (F.coalesce("password", F.lit("")) == "")
    return _judge(rows, [F.when(empty, "Enter your email and password.")])


def validate_logins(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid, rejected = _split(judge_logins(feed), feed.columns)
    return valid.select("feed_id", F.col("n_email").alias("email")), rejected.drop("password")
