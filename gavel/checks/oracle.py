"""The same results as plain SQL over the given tables, for an independent engine.

Written against the source tables only: each query carries the common table
expressions it needs, from the derived marketplace up to the settled market.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
AS_OF_ISO = "'2024-01-20T00:00:00.000Z'"
TWO_MINUTES, SIX_HOURS, THREE_DAYS = 120_000, 21_600_000, 259_200_000


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def inr(amount: str) -> str:
    digits = f"CAST({amount} AS VARCHAR)"
    head = f"reverse(left({digits}, length({digits}) - 3))"
    return (f"'₹' || CASE WHEN length({digits}) <= 3 THEN {digits} ELSE "
            f"reverse(rtrim(regexp_replace({head}, '([0-9]{{2}})', '\\1,', 'g'), ',')) "
            f"|| ',' || right({digits}, 3) END")


def ago(ts: str) -> str:
    ms = f"({AS_MS} - epoch_ms({ts}))"
    return (f"CASE WHEN {ms} < 60000 THEN 'just now' "
            f"WHEN {ms} < 3600000 THEN ({ms} // 60000) || 'm ago' "
            f"WHEN {ms} < 86400000 THEN ({ms} // 3600000) || 'h ago' "
            f"ELSE ({ms} // 86400000) || 'd ago' END")


AS_MS = f"epoch_ms({AS_OF})"

BASE = """
n AS (SELECT count(*) AS n FROM part),
users AS (
  SELECT c_custkey + 1 AS id, c_mktsegment AS first_name, CAST(c_custkey AS VARCHAR) AS last_name,
         replace(c_name, '#', '.') || '@Example.com' AS email,
         CASE WHEN c_custkey % 7 <> 0
              THEN '+91 9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS phone,
         CASE WHEN c_custkey % 10 = 0 THEN 'seller' ELSE 'buyer' END AS role,
         TIMESTAMP '2023-12-01 00:00:00' AS created_at
  FROM customer),
items AS (
  SELECT p_partkey + 1 AS id, (p_partkey % 15) * 10 + 1 AS seller_id, p_name AS title,
         p_brand AS description, p_type AS category,
         'https://img.example.com/' || p_partkey || '.jpg' AS image_url,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM part),
base_auctions AS (
  SELECT p_partkey + 1 AS id, p_partkey + 1 AS item_id,
         CAST(floor(p_retailprice) AS BIGINT) - 890 AS starting_price,
         TIMESTAMP '2024-01-01 00:00:00' AS start_time,
         TIMESTAMP '2024-01-05 00:00:00' + (p_partkey % 25) * INTERVAL 1 DAY AS end_time,
         CASE WHEN p_partkey % 17 = 0 THEN 'cancelled' ELSE 'open' END AS status
  FROM part WHERE p_size <> 50
  UNION ALL
  SELECT p_partkey + 1 + n, p_partkey + 1, CAST(floor(p_retailprice) AS BIGINT) - 890,
         TIMESTAMP '2024-01-15 00:00:00',
         TIMESTAMP '2024-01-30 00:00:00' + (p_partkey % 5) * INTERVAL 1 DAY, 'open'
  FROM part, n WHERE p_size = 1),
requests AS (
  SELECT event_id + 1 AS id, event_type, user_id, value, date_trunc('millisecond', ts) AS ts,
         CAST(CASE WHEN event_id % 3 = 0 THEN (event_id // 3) % 20
              ELSE event_id % (n + n // 10) END AS BIGINT) + 1 AS auction_id
  FROM events, n),
attempts AS (
  SELECT id, auction_id, user_id + 1 AS bidder_id, CAST(floor(value) AS BIGINT) AS amount,
         ts AS created_at, epoch_ms(ts) AS t
  FROM requests WHERE event_type IN ('click', 'view', 'purchase'))"""


def replayed(window_ms: int, heard: str = "TRUE") -> str:
    """Outcome of every attempt by successive windows over each auction."""
    before = ("OVER (PARTITION BY auction_id ORDER BY t, id "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    so_far = ("OVER (PARTITION BY auction_id ORDER BY t, id "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return f"""
r1 AS (
  SELECT x.*, a.id AS found, a.status, a.starting_price, i.seller_id,
         epoch_ms(a.end_time) AS end_ms,
         coalesce(x.amount >= 1 AND a.status = 'open' AND x.bidder_id <> i.seller_id
                  AND x.amount >= a.starting_price, FALSE) AS elig
  FROM attempts x LEFT JOIN base_auctions a ON a.id = x.auction_id
  LEFT JOIN items i ON i.id = a.item_id WHERE {heard}),
r2 AS (SELECT *, max(CASE WHEN elig THEN amount END) {before} AS best FROM r1),
r3 AS (SELECT *, elig AND (best IS NULL OR amount > best) AS cand FROM r2),
r4 AS (SELECT *, greatest(end_ms, coalesce(max(CASE WHEN cand THEN t END) {before} + {window_ms},
                                           end_ms)) AS eff_end FROM r3),
r5 AS (SELECT *, bool_or(coalesce(cand AND t >= eff_end, FALSE)) {so_far} AS dead FROM r4),
r6 AS (SELECT *, cand AND NOT dead AS acc FROM r5),
r7 AS (SELECT *, max(CASE WHEN acc THEN amount END) {before} AS price,
              greatest(end_ms, coalesce(max(CASE WHEN acc THEN t END) {before} + {window_ms},
                                        end_ms)) AS cur_end FROM r6),
r8 AS (
  SELECT *, CASE WHEN amount < 1 THEN 'INVALID_AMOUNT' WHEN found IS NULL THEN 'NOT_FOUND'
                 WHEN status <> 'open' OR t >= cur_end THEN 'CLOSED'
                 WHEN bidder_id = seller_id THEN 'OWN_ITEM'
                 WHEN price IS NULL AND amount < starting_price THEN 'BELOW_START'
                 WHEN price IS NOT NULL AND amount <= price THEN 'TOO_LOW'
                 ELSE 'ACCEPTED' END AS outcome
  FROM r7),
outcomes AS (
  SELECT id, auction_id, bidder_id, amount, created_at, t, outcome,
         CASE WHEN outcome = 'ACCEPTED' THEN amount END AS price_after,
         CASE WHEN outcome = 'ACCEPTED'
              THEN make_timestamp(greatest(cur_end, t + {window_ms}) * 1000) END AS end_after,
         outcome = 'ACCEPTED' AND cur_end - t <= {window_ms} AS extended
  FROM r8),
bids AS (SELECT id, auction_id, bidder_id, amount, created_at FROM outcomes
         WHERE outcome = 'ACCEPTED'),
bid_auctions AS (
  SELECT a.id, a.item_id, a.starting_price, coalesce(o.price, a.starting_price) AS current_price,
         a.start_time, coalesce(o.ends, a.end_time) AS end_time, a.status
  FROM base_auctions a LEFT JOIN (
    SELECT auction_id, max(price_after) AS price, max(end_after) AS ends FROM outcomes
    WHERE outcome = 'ACCEPTED' GROUP BY auction_id) o ON o.auction_id = a.id),
counts AS (SELECT auction_id, count(*) AS bid_count FROM bids GROUP BY auction_id),
leaders AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY auction_id
                                              ORDER BY amount DESC, id) AS rn FROM bids)
  WHERE rn = 1)"""


def extended_by(window_ms: int, extension_ms: int) -> str:
    """The same where late bids move the end by a time of its own: bids that rise above all
    before are followed one by one."""
    whole = replayed(window_ms)
    head, tail = whole[:whole.index("r4 AS")], whole[whole.index("r8 AS"):]
    before = ("OVER (PARTITION BY auction_id ORDER BY t, id "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    so_far = ("OVER (PARTITION BY auction_id ORDER BY t, id "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    late = "c.t < {0} AND {0} - c.t <= " + str(window_ms)
    return f"""{head}
rising AS (SELECT auction_id, id, t, end_ms,
                  row_number() OVER (PARTITION BY auction_id ORDER BY t, id) AS k FROM r3 WHERE cand),
chain AS (
  SELECT c.auction_id, c.id, c.k,
         CASE WHEN {late.format('c.end_ms')} THEN c.t + {extension_ms} ELSE c.end_ms END AS ends
  FROM rising c WHERE c.k = 1
  UNION ALL
  SELECT c.auction_id, c.id, c.k,
         CASE WHEN {late.format('h.ends')} THEN c.t + {extension_ms} ELSE h.ends END
  FROM chain h JOIN rising c ON c.auction_id = h.auction_id AND c.k = h.k + 1),
r4 AS (SELECT r3.*, h.ends FROM r3 LEFT JOIN chain h USING (auction_id, id)),
r5 AS (SELECT *, coalesce(last_value(ends IGNORE NULLS) {before}, end_ms) AS cur_end FROM r4),
r6 AS (SELECT *, cand AND NOT bool_or(coalesce(t >= cur_end, FALSE)) {so_far} AS acc FROM r5),
r7 AS (SELECT *, max(CASE WHEN acc THEN amount END) {before} AS price FROM r6),
{tail.replace(f"greatest(cur_end, t + {window_ms})", f"CASE WHEN cur_end - t <= {window_ms} THEN t + {extension_ms} ELSE cur_end END")}"""


SETTLED = f"""
auctions AS (
  SELECT a.id, a.item_id, a.starting_price, a.current_price, a.start_time, a.end_time,
         CASE WHEN a.status = 'open' AND a.end_time <= {AS_OF} THEN 'closed'
              ELSE a.status END AS status,
         CASE WHEN a.status = 'open' AND a.end_time <= {AS_OF} THEN l.bidder_id END AS winner_id
  FROM bid_auctions a LEFT JOIN leaders l ON l.auction_id = a.id),
invoices AS (
  SELECT a.id, a.id AS auction_id, a.winner_id AS buyer_id, i.seller_id, a.current_price AS amount,
         'pending' AS status, {AS_OF} AS created_at
  FROM auctions a JOIN items i ON i.id = a.item_id WHERE a.winner_id IS NOT NULL)"""

PAYMENTS = f"""
payment_attempts AS (
  SELECT id * 2 AS id, id AS auction_id,
         CASE WHEN id % 3 = 1 THEN id % 150 + 1 ELSE coalesce(winner_id, 1) END AS buyer_id,
         TIMESTAMP '2024-01-20 01:00:00' AS created_at FROM auctions
  UNION ALL
  SELECT id * 2 + 1, id, coalesce(winner_id, 1), TIMESTAMP '2024-01-20 01:01:00' FROM auctions),
checkout AS (
  SELECT p.id, p.auction_id, p.buyer_id,
         CASE WHEN v.id IS NULL THEN 'NOT_FOUND' WHEN p.buyer_id <> v.buyer_id THEN 'NOT_WINNER'
              WHEN count(*) FILTER (WHERE p.buyer_id = v.buyer_id) OVER (
                PARTITION BY p.auction_id ORDER BY p.created_at, p.id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'ALREADY_PAID'
              ELSE 'PAID' END AS outcome
  FROM payment_attempts p LEFT JOIN invoices v ON v.auction_id = p.auction_id),
paid_invoices AS (
  SELECT v.id, v.auction_id, v.buyer_id, v.seller_id, v.amount,
         CASE WHEN EXISTS (SELECT 1 FROM checkout c WHERE c.auction_id = v.auction_id
                           AND c.outcome = 'PAID') THEN 'paid' ELSE v.status END AS status,
         v.created_at
  FROM invoices v)"""

FEEDS = r"""
listing_feed AS (
  SELECT p_partkey + 1 AS feed_id, (p_partkey % 15) * 10 + 1 AS seller_id,
         CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 11 = 1 THEN trim(repeat(p_name, 30))
              ELSE p_name END AS title,
         CASE WHEN p_size % 13 = 0 THEN '' WHEN p_size % 13 = 1 THEN trim(repeat('long text ', 101))
              ELSE p_brand END AS description,
         CASE WHEN p_size % 5 = 0 THEN p_type WHEN p_size % 5 = 1 THEN 'Diamonds'
              WHEN p_size % 5 = 2 THEN 'Luxury Watches' ELSE 'Women''s Jewelry' END AS category,
         CASE WHEN p_size % 7 = 0 THEN 'javascript:alert(1)' WHEN p_size % 7 = 1
              THEN '/images/photo.jpg' WHEN p_size % 7 = 2 THEN ''
              ELSE 'HTTPS://img.example.com/' || p_partkey END AS image_url,
         CASE p_partkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 12.5 WHEN 2 THEN NULL WHEN 3 THEN 1000
              WHEN 4 THEN 200000000 WHEN 5 THEN 16 ELSE p_size * 100 END::DOUBLE AS price,
         CASE p_partkey % 8 WHEN 1 THEN TIMESTAMP '2024-01-20 00:04:59.999'
              WHEN 2 THEN TIMESTAMP '2024-01-20 00:05:00' WHEN 3 THEN TIMESTAMP '2024-02-19 00:00:00'
              WHEN 4 THEN TIMESTAMP '2024-02-19 00:00:00.001'
              WHEN 5 THEN TIMESTAMP '2024-01-25 04:30:00'
              WHEN 7 THEN TIMESTAMP '2024-01-22 12:30:00.5' END AS end_time
  FROM part),
listing_errors AS (
  SELECT *, concat_ws(' | ',
      CASE WHEN title = '' THEN 'Item title is required.'
           WHEN length(title) > 120 THEN 'Title must be under 120 characters.' END,
      CASE WHEN description = '' THEN 'Description is required.'
           WHEN length(description) > 1000 THEN 'Description must be under 1000 characters.' END,
      CASE WHEN category NOT IN ('Women''s Jewelry', 'Luxury Watches', 'Diamonds')
           THEN 'Choose a category from the list.' END,
      CASE WHEN image_url = '' OR length(image_url) > 500 THEN 'Photo URL is required.'
           WHEN lower(image_url) NOT LIKE 'http%://%'
           THEN 'Photo URL must start with http:// or https://' END,
      CASE WHEN price IS NULL OR price <> floor(price)
           THEN 'Starting bid must be a whole number of rupees.'
           WHEN price < 1 OR price > 100000000
           THEN 'Starting bid must be between ₹1 and ₹10,00,00,000.' END,
      CASE WHEN end_time IS NULL THEN 'Choose when the auction ends.'
           WHEN end_time < TIMESTAMP '2024-01-20 00:05:00'
           THEN 'End time must be at least 5 minutes from now.'
           WHEN end_time > TIMESTAMP '2024-02-19 00:00:00'
           THEN 'Auctions can run for at most 30 days.' END) AS errors
  FROM listing_feed),
registration_feed AS (
  SELECT c_custkey + 1 AS feed_id,
         CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN repeat('N', 101)
              ELSE c_mktsegment END AS first_name,
         CASE WHEN c_custkey % 12 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS last_name,
         lower(CASE WHEN c_custkey % 5 = 0 THEN replace(c_name, '#', '.') || '@example.com'
              WHEN c_custkey % 5 = 1 THEN 'new' || (c_custkey // 10) || '@example.org'
              WHEN c_custkey % 5 = 2 THEN 'new' || c_custkey || '@example'
              ELSE 'new' || c_custkey || '@example.net' END) AS email,
         CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '+91 8' || c_custkey END AS phone,
         CASE WHEN c_custkey % 9 = 0 THEN 'short' ELSE 'secret-' || c_custkey || '-x' END AS password,
         CASE WHEN c_custkey % 9 = 0 THEN 'short' WHEN c_custkey % 9 = 1 THEN 'different'
              ELSE 'secret-' || c_custkey || '-x' END AS confirm,
         CASE WHEN c_custkey % 4 = 0 THEN 'seller' ELSE 'buyer' END AS role
  FROM customer),
registration_errors AS (
  SELECT *, concat_ws(' | ',
      CASE WHEN first_name = '' OR last_name = '' THEN 'First name and last name are required.' END,
      CASE WHEN length(first_name) > 100 OR length(last_name) > 100 THEN 'Name is too long.' END,
      CASE WHEN NOT regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+')
           THEN 'Enter a valid email address.' END,
      CASE WHEN phone = '' THEN 'Phone number is required.' END,
      CASE WHEN length(password) < 8 THEN 'Password must be at least 8 characters.' END,
      CASE WHEN password <> confirm THEN 'Passwords do not match.' END) AS errors
  FROM registration_feed)"""

ROOMS = """
subscriptions AS (
  SELECT id, user_id + 1 AS client_id, ts,
         CASE WHEN event_type = 'click' THEN 'all' ELSE CAST(auction_id AS VARCHAR) END AS room
  FROM requests WHERE event_type IN ('view', 'purchase', 'click')),
stays AS (
  SELECT client_id, room, id, ts AS from_ts,
         lead(ts) OVER (PARTITION BY client_id ORDER BY ts, id) AS to_ts
  FROM subscriptions)"""

CARD = """a.id AS "auctionId", a.current_price AS "currentPrice",
  a.starting_price AS "startingPrice", """ + iso("a.end_time") + """ AS "endTime", a.status,
  i.title, i.category, i.image_url AS "imageUrl", coalesce(c.bid_count, 0) AS "bidCount" """
CARD_FROM = """FROM auctions a JOIN items i ON i.id = a.item_id
  LEFT JOIN counts c ON c.auction_id = a.id"""

DETAIL = f"""
detail AS (
  SELECT a.id AS "auctionId", a.starting_price AS "startingPrice",
         a.current_price AS "currentPrice", {iso('a.start_time')} AS "startTime",
         {iso('a.end_time')} AS "endTime", a.status, a.winner_id AS "winnerId",
         w.first_name || ' ' || left(w.last_name, 1) || '.' AS "winnerName", i.id AS "itemId",
         i.title, i.description, i.category, i.image_url AS "imageUrl", u.id AS "sellerId",
         u.first_name || ' ' || u.last_name AS "sellerName",
         coalesce(c.bid_count, 0) AS "bidCount",
         a.status = 'open' AND a.end_time > {AS_OF} AS "isBiddable"
  FROM auctions a JOIN items i ON i.id = a.item_id JOIN users u ON u.id = i.seller_id
  LEFT JOIN users w ON w.id = a.winner_id LEFT JOIN counts c ON c.auction_id = a.id)"""

MY_BIDS = f"""
my_bids AS (
  SELECT b.bidder_id AS "userId", {CARD}, max(b.amount) AS "myBid", count(*) AS "myBidCount",
         {iso('max(b.created_at)')} AS "lastBidAt",
         CASE WHEN max(b.amount) = a.current_price THEN 1 ELSE 0 END AS "isWinning"
  FROM bids b JOIN auctions a ON a.id = b.auction_id JOIN items i ON i.id = a.item_id
  JOIN counts c ON c.auction_id = a.id
  GROUP BY b.bidder_id, a.id, a.current_price, a.starting_price, a.end_time, a.status, i.title,
           i.category, i.image_url, c.bid_count)"""


def _listings(invoices: str) -> str:
    return f"""
listings AS (
  SELECT i.seller_id AS "sellerId", {CARD}, i.id AS "itemId", t.status AS "paymentStatus",
         a.winner_id AS "winnerId"
  FROM items i LEFT JOIN auctions a ON a.item_id = i.id
  LEFT JOIN counts c ON c.auction_id = a.id LEFT JOIN {invoices} t ON t.auction_id = a.id)"""


def _wins(invoices: str) -> str:
    return f"""
wins AS (
  SELECT a.winner_id AS "userId", a.id AS "auctionId", a.current_price AS amount,
         {iso('a.end_time')} AS "endTime", i.title, i.category, i.image_url AS "imageUrl",
         t.status AS "paymentStatus", u.first_name || ' ' || u.last_name AS "sellerName",
         coalesce(c.bid_count, 0) AS "bidCount"
  FROM auctions a JOIN items i ON i.id = a.item_id JOIN users u ON u.id = i.seller_id
  LEFT JOIN {invoices} t ON t.auction_id = a.id LEFT JOIN counts c ON c.auction_id = a.id
  WHERE a.status = 'closed' AND a.winner_id IS NOT NULL)"""


BUYER_STATS = """
buyer_stats AS (
  SELECT u.id AS "userId", coalesce(m.active, 0) AS "activeBids",
         coalesce(m.winning, 0) AS "currentlyWinning",
         CASE WHEN coalesce(w.unpaid, 0) > 0 THEN 'Payment Due' ELSE 'Auctions Won' END
           AS "paymentLabel",
         CASE WHEN coalesce(w.unpaid, 0) > 0 THEN w.unpaid ELSE coalesce(w.won, 0) END
           AS "paymentValue"
  FROM users u LEFT JOIN (
    SELECT "userId", count(*) FILTER (WHERE status = 'open') AS active,
           count(*) FILTER (WHERE status = 'open' AND "isWinning" = 1) AS winning
    FROM my_bids GROUP BY "userId") m ON m."userId" = u.id
  LEFT JOIN (
    SELECT "userId", count(*) AS won,
           count(*) FILTER (WHERE "paymentStatus" IS DISTINCT FROM 'paid') AS unpaid
    FROM wins GROUP BY "userId") w ON w."userId" = u.id)"""

SELLER_STATS = f"""
seller_sums AS (
  SELECT "sellerId", count(*) FILTER (WHERE status = 'open') AS active,
         sum("bidCount") AS received, max("currentPrice") FILTER (WHERE status = 'open') AS best
  FROM listings GROUP BY "sellerId"),
seller_stats AS (
  SELECT u.id AS "userId", coalesce(s.active, 0) AS "activeListings",
         CAST(coalesce(s.received, 0) AS BIGINT) AS "bidsReceived",
         CASE WHEN coalesce(s.best, 0) > 0 THEN {inr('s.best')} ELSE '—' END AS "highestBid"
  FROM users u LEFT JOIN seller_sums s ON s."sellerId" = u.id)"""


def _throttle(max_failures: int, window_ms: int) -> str:
    """The state machine, one attempt per recursion step and key."""
    return f"""
logins AS (
  SELECT id, '10.0.0.' || (user_id % 250) AS ip, 'user' || user_id || '@example.com' AS email,
         event_type = 'signup' AS success, epoch_ms(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn
  FROM requests WHERE event_type IN ('error', 'signup')),
judged AS (
  SELECT id, ip, email, success, rn,
         CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END AS outcome,
         CASE WHEN success THEN 0 ELSE 1 END AS n,
         CASE WHEN success THEN 0 ELSE t + {window_ms} END AS until
  FROM logins WHERE rn = 1
  UNION ALL
  SELECT l.id, l.ip, l.email, l.success, l.rn,
         CASE WHEN j.until > l.t AND j.n >= {max_failures} THEN 'LOCKED'
              WHEN l.success THEN 'SUCCESS' ELSE 'FAILED' END,
         CASE WHEN j.until > l.t AND j.n >= {max_failures} THEN j.n WHEN l.success THEN 0
              WHEN j.until > l.t THEN j.n + 1 ELSE 1 END,
         CASE WHEN j.until > l.t AND j.n >= {max_failures} THEN j.until WHEN l.success THEN 0
              WHEN j.until > l.t THEN j.until ELSE l.t + {window_ms} END
  FROM judged j JOIN logins l ON l.email = j.email AND l.rn = j.rn + 1)"""


DAMAGED = """
d_users AS (
  SELECT id, first_name, CASE WHEN first_name <> 'BUILDING' THEN last_name END AS last_name, email,
         CASE WHEN phone IS NULL THEN 'admin' ELSE role END AS role FROM users
  UNION ALL
  SELECT id + 1000000, first_name, last_name, upper(email), role FROM users WHERE phone IS NULL),
d_items AS (
  SELECT id, CASE WHEN category = 'PROMO' THEN seller_id + 5000000 ELSE seller_id END AS seller_id
  FROM items),
d_auctions AS (
  SELECT id, item_id, starting_price, start_time,
         CASE WHEN starting_price < 20 THEN -starting_price ELSE current_price END AS current_price,
         CASE WHEN starting_price > 100 THEN start_time ELSE end_time END AS end_time,
         CASE WHEN status = 'cancelled' THEN 'paused' ELSE status END AS status,
         CASE WHEN winner_id < 50 THEN winner_id + 9000000 ELSE winner_id END AS winner_id
  FROM auctions),
d_bids AS (
  SELECT id, CASE WHEN bidder_id < 10 THEN auction_id + 7000000 ELSE auction_id END AS auction_id,
         bidder_id, CASE WHEN amount < 30 THEN 0 ELSE amount END AS amount FROM bids),
d_transactions AS (
  SELECT id, auction_id, buyer_id, seller_id, amount,
         CASE WHEN amount > 200 THEN 'refunded' ELSE status END AS status FROM invoices
  UNION ALL
  SELECT id + 3000000, auction_id, buyer_id, seller_id, 0, status FROM invoices WHERE amount < 100)"""


def _rule(name: str, table: str, detail: str, where: str) -> str:
    return (f"SELECT '{name}' AS rule, '{table}' AS table_name, CAST(id AS VARCHAR) AS row_key, "
            f"CAST({detail} AS VARCHAR) AS detail FROM d_{table} WHERE {where}")


DOMAINS = "\nUNION ALL ".join([
    _rule("domain:role", "users", "role", "role NOT IN ('buyer', 'seller')"),
    _rule("domain:status", "auctions", "status", "status NOT IN ('open', 'closed', 'cancelled')"),
    _rule("domain:status", "transactions", "status", "status NOT IN ('pending', 'paid')")])
RANGES = "\nUNION ALL ".join([
    _rule("range:starting_price", "auctions", "starting_price", "starting_price < 0"),
    _rule("range:current_price", "auctions", "current_price", "current_price < 0"),
    _rule("range:end_time", "auctions", "epoch_ms(end_time) - epoch_ms(start_time)",
          "end_time <= start_time"),
    _rule("range:amount", "bids", "amount", "amount <= 0"),
    _rule("range:amount", "transactions", "amount", "amount <= 0")])
NOT_NULL = _rule("not_null:last_name", "users", "NULL", "last_name IS NULL")


def _duplicates(table: str, column: str, key: str) -> str:
    return (f"SELECT 'unique:{column}' AS rule, '{table}' AS table_name, "
            f"CAST({key} AS VARCHAR) AS row_key, CAST(count(*) AS VARCHAR) AS detail "
            f"FROM d_{table} GROUP BY {key} HAVING count(*) > 1")


UNIQUE = "\nUNION ALL ".join([
    *[_duplicates(t, "id", "id") for t in ("users", "items", "auctions", "bids", "transactions")],
    _duplicates("users", "email", "lower(email)"),
    _duplicates("transactions", "auction_id", "auction_id")])


def _orphans(child: str, column: str, parent: str) -> str:
    return (f"SELECT 'foreign_key:{column}' AS rule, '{child}' AS table_name, "
            f"CAST({column} AS VARCHAR) AS row_key, CAST(count(*) AS VARCHAR) AS detail "
            f"FROM d_{child} x WHERE {column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM d_{parent} p WHERE p.id = x.{column}) GROUP BY {column}")


FOREIGN_KEYS = "\nUNION ALL ".join([
    _orphans("items", "seller_id", "users"), _orphans("auctions", "item_id", "items"),
    _orphans("auctions", "winner_id", "users"), _orphans("bids", "auction_id", "auctions"),
    _orphans("bids", "bidder_id", "users"), _orphans("transactions", "auction_id", "auctions"),
    _orphans("transactions", "buyer_id", "users"), _orphans("transactions", "seller_id", "users")])
PRICE_RULE = """SELECT 'invariant:current_price' AS rule, 'auctions' AS table_name,
  CAST(a.id AS VARCHAR) AS row_key, CAST(max(b.amount) AS VARCHAR) AS detail
  FROM d_auctions a JOIN d_bids b ON b.auction_id = a.id GROUP BY a.id, a.current_price
  HAVING max(b.amount) <> a.current_price"""

HEARD = f"x.created_at <= {AS_OF}"
REPLAY_2M, REPLAY_6H = replayed(TWO_MINUTES), replayed(SIX_HOURS)
MARKET = [BASE, replayed(TWO_MINUTES, HEARD), SETTLED]
PAID_MARKET = [*MARKET, PAYMENTS]

# The bid stream closes what its last watermark, ten minutes behind, has passed.
CLOSED_LIVE = """
live_clock AS (SELECT max(created_at) - INTERVAL 10 MINUTE AS now FROM attempts),
live_closed AS (
  SELECT a.id AS auction_id, a.end_time, l.bidder_id AS winner_id, l.amount,
         coalesce(c.bid_count, 0) AS bid_count, a.current_price
  FROM bid_auctions a CROSS JOIN live_clock LEFT JOIN leaders l ON l.auction_id = a.id
  LEFT JOIN counts c ON c.auction_id = a.id
  WHERE a.status = 'open' AND a.end_time <= now)"""

SESSIONS = f"""
signals AS (
  SELECT user_id + 1 AS client_id, ts, id,
         lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) AS previous FROM requests),
numbered AS (
  SELECT *, sum(CASE WHEN previous IS NULL OR epoch_ms(ts) - epoch_ms(previous) > {SIX_HOURS}
                     THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY ts, id) AS session
  FROM signals),
sessions AS (
  SELECT client_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS signals
  FROM numbered GROUP BY client_id, session)"""
SESSION_COLUMNS = (f"client_id, {iso('session_start')} AS session_start, "
                   f"{iso('session_end')} AS session_end, signals")

OUTCOME_COLUMNS = (f"SELECT id, auction_id, bidder_id, amount, outcome, price_after, "
                   f"{iso('end_after')} AS end_after, extended FROM outcomes")


def _history(k: int) -> str:
    return f"""SELECT b.auction_id AS "auctionId", b.rn AS position, b.id, b.amount,
  {iso('b.created_at')} AS "placedAt", b.bidder_id AS "bidderId",
  u.first_name || ' ' || left(u.last_name, 1) || '.' AS "bidderName", b.rn = 1 AS "isHighest"
  FROM (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY amount DESC, id DESC) AS rn
        FROM bids) b JOIN users u ON u.id = b.bidder_id WHERE b.rn <= {k}"""


def _feed(k: int) -> str:
    return f"""SELECT {CARD}, u.id AS "sellerId", u.first_name || ' ' || u.last_name AS "sellerName"
  {CARD_FROM} JOIN users u ON u.id = i.seller_id
  WHERE a.status = 'open' ORDER BY a.end_time, a.id LIMIT {k}"""


def _sql(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE' if recursive else ''}{','.join(ctes)}\n{select}"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    tables = ("users", "items", "auctions", "bids")
    q["scan_tables"] = _sql(MARKET, "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(sum(id) AS BIGINT) AS id_sum "
        f"FROM {cte}" for name, cte in [*zip(tables, tables), ("transactions", "invoices")]))
    q["public_users"] = _sql([BASE], f"""SELECT id, first_name, last_name, email, phone, role,
        {iso('created_at')} AS created_at FROM users""")
    q["user_by_email"] = _sql([BASE, FEEDS], """SELECT r.feed_id, u.id, u.first_name, u.last_name,
        u.email, u.role FROM registration_feed r JOIN users u ON lower(u.email) = r.email""")
    q["email_exists"] = _sql([BASE, FEEDS], """SELECT feed_id,
        email IN (SELECT lower(email) FROM users) AS taken FROM registration_feed""")
    q["ingest_users"] = _sql([BASE, FEEDS], f"""SELECT
        (SELECT max(id) FROM users) + row_number() OVER (ORDER BY feed_id) AS id, first_name,
        last_name, email, phone, role, {AS_OF_ISO} AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY feed_id) AS rn
              FROM registration_errors WHERE errors = '') r
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = r.email)""")
    valid = "(SELECT *, row_number() OVER (ORDER BY feed_id) AS nth FROM listing_errors WHERE errors = '')"
    q["ingest_listings_items"] = _sql([BASE, FEEDS], f"""SELECT
        (SELECT max(id) FROM items) + nth AS id, seller_id, title, description, category, image_url,
        {AS_OF_ISO} AS created_at FROM {valid}""")
    q["ingest_listings_auctions"] = _sql([BASE, FEEDS], f"""SELECT
        (SELECT max(id) FROM base_auctions) + nth AS id, (SELECT max(id) FROM items) + nth AS item_id,
        CAST(price AS BIGINT) AS starting_price, CAST(price AS BIGINT) AS current_price,
        {AS_OF_ISO} AS start_time, {iso('end_time')} AS end_time, 'open' AS status,
        CAST(NULL AS BIGINT) AS winner_id, {AS_OF_ISO} AS created_at FROM {valid}""")
    q["ingest_bids"] = _sql([BASE, REPLAY_2M], f"""SELECT id, auction_id, bidder_id, amount,
        {iso('created_at')} AS created_at FROM bids""")
    q["insert_or_ignore_txn"] = _sql(MARKET, f"""SELECT a.id, a.id AS auction_id,
        l.bidder_id AS buyer_id, i.seller_id, a.current_price AS amount, 'pending' AS status,
        {AS_OF_ISO} AS created_at
        FROM auctions a JOIN items i ON i.id = a.item_id JOIN leaders l ON l.auction_id = a.id
        WHERE NOT EXISTS (SELECT 1 FROM invoices v WHERE v.auction_id = a.id)""")
    q["apply_bid_to_auction"] = _sql([BASE, REPLAY_6H], f"""SELECT id, starting_price, current_price,
        {iso('end_time')} AS end_time, status FROM bid_auctions""")
    q["seed_bid_ladder"] = _sql(MARKET, f"""SELECT id AS auction_id, step,
        (SELECT list(id ORDER BY id) FROM users WHERE role = 'buyer')[
          step % (SELECT count(*) FROM users WHERE role = 'buyer') + 1] AS bidder_id,
        starting_price + CAST(floor((current_price - starting_price) * (step + 1) / bid_count + 0.5)
                              AS BIGINT) AS amount,
        {iso(f"make_timestamp(({AS_MS} - (bid_count - step) * 420000) * 1000)")} AS created_at
        FROM (SELECT a.*, c.bid_count, unnest(range(c.bid_count)) AS step
              FROM auctions a JOIN counts c ON c.auction_id = a.id)""")
    q["sink_json_feed"] = _sql([*MARKET, f"feed AS ({_feed(24)})"], """SELECT '{"auctionId":' ||
        "auctionId" || ',"currentPrice":' || "currentPrice" || ',"startingPrice":' ||
        "startingPrice" || ',"endTime":"' || "endTime" || '","status":"' || status ||
        '","title":"' || title || '","category":"' || category || '","imageUrl":"' || "imageUrl" ||
        '","bidCount":' || "bidCount" || ',"sellerId":' || "sellerId" || ',"sellerName":"' ||
        "sellerName" || '"}' AS document FROM feed""")
    gone = "(SELECT c_custkey + 1 FROM customer WHERE c_acctbal < 0)"
    gone_auctions = (f"(SELECT a.id FROM auctions a JOIN items i ON i.id = a.item_id "
                     f"WHERE i.seller_id IN {gone})")
    q["erase_cascade"] = _sql(MARKET, f"""
        SELECT 'users' AS table_name, id, CAST(NULL AS BIGINT) AS winner_id FROM users
        WHERE id NOT IN {gone}
        UNION ALL SELECT 'items', id, NULL FROM items WHERE seller_id NOT IN {gone}
        UNION ALL SELECT 'auctions', id, CASE WHEN winner_id NOT IN {gone} THEN winner_id END
        FROM auctions WHERE id NOT IN {gone_auctions}
        UNION ALL SELECT 'bids', id, NULL FROM bids
        WHERE auction_id NOT IN {gone_auctions} AND bidder_id NOT IN {gone}
        UNION ALL SELECT 'transactions', id, NULL FROM invoices
        WHERE auction_id NOT IN {gone_auctions} AND buyer_id NOT IN {gone}
        AND seller_id NOT IN {gone}""")

    q["auction_card"] = _sql(MARKET, f"SELECT {CARD} {CARD_FROM}")
    q["filter_due"] = _sql(MARKET, f"""SELECT id, {iso('end_time')} AS end_time FROM bid_auctions
        WHERE status = 'open' AND end_time <= {AS_OF}""")
    q["due_sort"] = _sql(MARKET, f"""SELECT id, {iso('end_time')} AS end_time,
        row_number() OVER (ORDER BY end_time, id) AS position FROM bid_auctions
        WHERE status = 'open' AND end_time <= {AS_OF}""")
    q["category_filter"] = _sql([*MARKET, f"feed AS ({_feed(24)})"],
                                "SELECT * FROM feed WHERE category = 'PROMO'")
    q["scalars_text"] = _sql([BASE, FEEDS], f"""SELECT feed_id, title AS norm_title,
        CAST(length(title) AS BIGINT) AS title_units, lower(category) || '@example.com' AS email,
        lower(image_url) LIKE 'http%://%' AS safe_url, price AS number,
        CASE WHEN price = floor(price) AND price > 0 THEN CAST(price AS BIGINT) END AS id,
        {iso('end_time')} AS "end" FROM listing_feed""")
    end = "strptime(d.\"endTime\", '%Y-%m-%dT%H:%M:%S.%gZ')"
    left = f"(epoch_ms({end}) - {AS_MS})"
    two = "lpad(CAST({} AS VARCHAR), 2, '0')".format
    won = """d."winnerName" IS NOT NULL AND d."auctionId" % 150 + 1 = d."winnerId" """
    at = f""" || ' at ' || {inr('d."currentPrice"')} || '.' """
    q["scalars_auction"] = _sql([*PAID_MARKET, DETAIL], f"""SELECT d."auctionId", d."sellerName",
        d."winnerName", d."isBiddable", {inr('d."currentPrice" * 12345')} AS money,
        CASE WHEN {left} <= 0 THEN 'Ended' ELSE
          CASE WHEN {left} >= 86400000 THEN ({left} // 86400000) || 'd ' ELSE '' END ||
          {two(f"{left} % 86400000 // 3600000")} || ':' || {two(f"{left} % 3600000 // 60000")} ||
          ':' || {two(f"{left} % 60000 // 1000")} END AS "timeLeft",
        {ago(end)} AS "endedAgo",
        CASE WHEN d."bidCount" = 0 THEN d."startingPrice" ELSE d."currentPrice" + 1 END
          AS "minNextBid",
        CASE WHEN d."bidCount" > 0 THEN 'Current Bid' ELSE 'Starting Bid' END AS "priceLabel",
        CASE WHEN d."bidCount" > 0 THEN 'Current Highest Bid' ELSE 'Starting Bid' END
          AS "detailLabel",
        d."bidCount" || CASE WHEN d."bidCount" = 1 THEN ' Bid' ELSE ' Bids' END AS "countLabel",
        CASE WHEN d.status = 'open' THEN 'Live' WHEN v.status = 'paid' THEN 'Sold · Paid'
             WHEN d."winnerId" IS NOT NULL THEN 'Sold · Awaiting payment' ELSE 'Unsold' END AS listing,
        CASE WHEN v.status = 'paid' THEN 'Paid' ELSE 'Payment due' END AS win,
        v.status IS DISTINCT FROM 'paid' AS unpaid,
        CASE WHEN {won} THEN 'You' ELSE d."winnerName" END AS bidder,
        CASE WHEN d."isBiddable" THEN NULL
             WHEN {won} AND v.status = 'paid'
             THEN 'You won this auction' {at} || ' Payment complete.'
             WHEN {won} THEN 'Congratulations - you won this auction' {at}
             WHEN d."winnerName" IS NOT NULL
             THEN 'This auction has ended. Won by ' || d."winnerName" {at}
             WHEN d.status = 'closed' THEN 'This auction ended with no bids.'
             ELSE 'This auction has ended.' END AS notice
        FROM detail d LEFT JOIN paid_invoices v ON v.auction_id = d."auctionId" """)
    last = "strptime(\"lastBidAt\", '%Y-%m-%dT%H:%M:%S.%gZ')"
    q["scalars_bids"] = _sql([*MARKET, MY_BIDS], f"""SELECT "userId", "auctionId",
        CASE WHEN status <> 'open' THEN 'Closed' WHEN "isWinning" = 1 THEN 'Winning'
             ELSE 'Outbid' END AS state, {inr('"myBid"')} AS "myBid", {ago(last)} AS ago
        FROM my_bids""")
    q["parse_subscribe"] = _sql([BASE, ROOMS], f"""SELECT id, client_id, {iso('ts')} AS ts, room
        FROM subscriptions""")

    q["bids_by_user"] = _sql([*MARKET, MY_BIDS], "SELECT * FROM my_bids")
    q["bid_count"] = _sql(MARKET, """SELECT a.id AS "auctionId", coalesce(c.bid_count, 0)
        AS "bidCount" FROM auctions a LEFT JOIN counts c ON c.auction_id = a.id""")
    q["buyer_stats"] = _sql([*PAID_MARKET, MY_BIDS, _wins("paid_invoices"), BUYER_STATS],
                            "SELECT * FROM buyer_stats")
    q["seller_stats"] = _sql([*MARKET, _listings("invoices"), SELLER_STATS],
                             "SELECT * FROM seller_stats")
    cards = [("buyer", 1, "'Active Bids'", "\"activeBids\""),
             ("buyer", 2, "'Currently Winning'", "\"currentlyWinning\""),
             ("buyer", 3, "\"paymentLabel\"", "\"paymentValue\""),
             ("seller", 1, "'Active Listings'", "\"activeListings\""),
             ("seller", 2, "'Bids Received'", "\"bidsReceived\""),
             ("seller", 3, "'Highest Bid'", "\"highestBid\"")]
    q["dashboard_role_view"] = _sql(
        [*PAID_MARKET, MY_BIDS, _wins("paid_invoices"), BUYER_STATS, _listings("paid_invoices"),
         SELLER_STATS],
        "\nUNION ALL ".join(f"""SELECT s."userId", u.role, {card} AS card, {label} AS label,
        CAST({value} AS VARCHAR) AS value FROM {role}_stats s JOIN users u ON u.id = s."userId"
        WHERE u.role = '{role}'""" for role, card, label, value in cards))
    q["invariant_max_eq_current"] = _sql(MARKET, """SELECT count(*) AS auctions_with_bids,
        count(*) FILTER (WHERE b.top <> a.current_price) AS violations
        FROM (SELECT auction_id, max(amount) AS top FROM bids GROUP BY auction_id) b
        LEFT JOIN auctions a ON a.id = b.auction_id""")
    q["room_viewers"] = _sql([BASE, ROOMS], """SELECT room, count(*) AS viewers FROM stays
        WHERE to_ts IS NULL GROUP BY room""")

    q["replay_bids"] = _sql([BASE, REPLAY_2M], OUTCOME_COLUMNS)
    q["replay_bids_6h"] = _sql([BASE, REPLAY_6H], OUTCOME_COLUMNS)
    for name, extension in (("short", 7_200_000), ("long", 43_200_000)):
        q[f"replay_bids_{name}_extension"] = _sql(
            [BASE, extended_by(21_600_000, extension)], OUTCOME_COLUMNS).replace("WITH ", "WITH RECURSIVE ", 1)
    q["winning_bid"] = _sql(MARKET, f"""SELECT auction_id, id AS bid_id, bidder_id, amount,
        {iso('created_at')} AS created_at FROM leaders""")
    q["bid_history_topk"] = _sql(MARKET, _history(50))
    q["bid_history_top3"] = _sql(MARKET, _history(3))
    q["bids_received_topk"] = _sql(MARKET, f"""SELECT r.seller_id AS "sellerId", r.rn AS position,
        r.amount, {iso('r.created_at')} AS "placedAt", r.title, r.auction_id AS "auctionId",
        u.first_name || ' ' || u.last_name AS "bidderName"
        FROM (SELECT b.*, i.seller_id, i.title, row_number() OVER (
                PARTITION BY i.seller_id ORDER BY b.created_at DESC, b.id DESC) AS rn
              FROM bids b JOIN auctions a ON a.id = b.auction_id JOIN items i ON i.id = a.item_id) r
        JOIN users u ON u.id = r.bidder_id WHERE r.rn <= 10""")
    q["replay_checkout"] = _sql(PAID_MARKET, "SELECT * FROM checkout")
    logins = "SELECT id, ip, email, success, outcome FROM judged"
    q["replay_login_throttle"] = _sql([BASE, _throttle(10, 900_000)], logins, recursive=True)
    q["replay_login_throttle_3d"] = _sql([BASE, _throttle(3, THREE_DAYS)], logins, recursive=True)

    q["open_auctions_feed"] = _sql(MARKET, _feed(12))
    q["home_feed"] = _sql(MARKET, _feed(24))
    q["my_bids_sort"] = _sql([*MARKET, MY_BIDS], """SELECT "userId", "auctionId", "isWinning",
        "endTime", row_number() OVER (PARTITION BY "userId" ORDER BY "isWinning" DESC, "endTime",
        "auctionId") AS position FROM my_bids""")
    q["listings_sort"] = _sql([*MARKET, _listings("invoices")], """SELECT "sellerId", "itemId",
        "auctionId", "endTime", row_number() OVER (PARTITION BY "sellerId"
        ORDER BY "endTime" NULLS FIRST, "itemId", "auctionId" NULLS FIRST) AS position FROM listings""")
    q["wins_sort"] = _sql([*MARKET, _wins("invoices")], """SELECT "userId", "auctionId", "endTime",
        row_number() OVER (PARTITION BY "userId" ORDER BY "endTime" DESC, "auctionId" DESC)
        AS position FROM wins""")
    q["auction_detail"] = _sql([*MARKET, DETAIL], "SELECT * FROM detail")
    q["auction_page"] = _sql([*PAID_MARKET, DETAIL, f"history AS ({_history(50)})"], """SELECT
        d."auctionId", d.title, d."isBiddable", coalesce(h.bids, '') AS bids, v.status AS payment,
        d."auctionId" % 150 + 1 AS "viewerId", u.first_name AS "viewerName",
        d."auctionId" % 150 + 1 = d."sellerId" AS "viewerIsSeller"
        FROM detail d JOIN users u ON u.id = d."auctionId" % 150 + 1
        LEFT JOIN paid_invoices v ON v.auction_id = d."auctionId"
        LEFT JOIN (SELECT "auctionId", string_agg(id || ':' || "bidderName", ',' ORDER BY position)
                   AS bids FROM history GROUP BY "auctionId") h ON h."auctionId" = d."auctionId" """)
    q["sink_json_page"] = _sql([*PAID_MARKET, DETAIL, f"history AS ({_history(50)})", """
        pages AS (SELECT d."auctionId", d AS auction, coalesce(h.bids, []) AS bids,
          CASE WHEN v.id IS NOT NULL THEN struct_pack(id := v.id, "auctionId" := v.auction_id,
            "buyerId" := v.buyer_id, "sellerId" := v.seller_id, amount := v.amount,
            status := v.status, "createdAt" := """ + iso("v.created_at") + """) END AS payment,
          CAST(NULL AS VARCHAR) AS viewer
        FROM detail d LEFT JOIN paid_invoices v ON v.auction_id = d."auctionId"
        LEFT JOIN (SELECT "auctionId", list(struct_pack(id := id, amount := amount,
            "placedAt" := "placedAt", "bidderId" := "bidderId", "bidderName" := "bidderName")
            ORDER BY position) AS bids FROM history GROUP BY "auctionId") h
          ON h."auctionId" = d."auctionId")"""],
        "SELECT CAST(to_json(p) AS VARCHAR) AS document FROM pages p")
    q["sink_json_wins"] = _sql(
        [*PAID_MARKET, _wins("paid_invoices")],
        """SELECT CAST(to_json(w) AS VARCHAR) AS document FROM (
           SELECT "userId", "auctionId", amount, "endTime", title, category, "imageUrl",
                  "paymentStatus", "sellerName", "bidCount" FROM wins) w""")
    q["listings_by_seller"] = _sql([*PAID_MARKET, _listings("paid_invoices")],
                                   "SELECT * FROM listings")
    q["wins_by_buyer"] = _sql([*PAID_MARKET, _wins("paid_invoices")], "SELECT * FROM wins")
    q["transaction_by_auction"] = _sql(PAID_MARKET, f"""SELECT id, auction_id AS "auctionId",
        buyer_id AS "buyerId", seller_id AS "sellerId", amount, status,
        {iso('created_at')} AS "createdAt" FROM paid_invoices""")
    q["settle_auctions"] = _sql(MARKET, f"""SELECT id, current_price, {iso('end_time')} AS end_time,
        status, winner_id FROM auctions""")
    q["settle_transactions"] = _sql(MARKET, f"""SELECT id, auction_id, buyer_id, seller_id, amount,
        status, {iso('created_at')} AS created_at FROM invoices""")
    q["sale_details"] = _sql(MARKET, """SELECT a.id AS auction_id, i.seller_id,
        a.current_price AS amount FROM auctions a JOIN items i ON i.id = a.item_id""")
    q["market_snapshot"] = _sql(MARKET, f"""SELECT a.id, a.status, a.current_price,
        {iso('a.end_time')} AS end_time, a.winner_id, coalesce(c.bid_count, 0) AS bid_count,
        v.seller_id, v.amount AS invoice
        FROM auctions a LEFT JOIN counts c ON c.auction_id = a.id
        LEFT JOIN invoices v ON v.auction_id = a.id""")

    q["validate_listings"] = _sql([BASE, FEEDS], f"""SELECT feed_id, seller_id, title, description,
        category, image_url, CAST(price AS BIGINT) AS starting_price,
        {iso('end_time')} AS end_time FROM listing_errors WHERE errors = ''""")
    rejected = "SELECT feed_id, errors, split_part(errors, ' | ', 1) AS first_error FROM {} WHERE errors <> ''"
    q["validate_listings_rejected"] = _sql([BASE, FEEDS], rejected.format("listing_errors"))
    q["validate_registrations"] = _sql([BASE, FEEDS], """SELECT feed_id, first_name, last_name, email,
        phone, role FROM registration_errors WHERE errors = ''""")
    q["validate_registrations_rejected"] = _sql([BASE, FEEDS],
                                                rejected.format("registration_errors"))
    bad_login = "c_custkey % 6 = 0 OR c_custkey % 7 IN (0, 1)"
    q["validate_logins"] = f"""SELECT c_custkey + 1 AS feed_id,
        'user' || c_custkey || '@example.com' AS email FROM customer WHERE NOT ({bad_login})"""
    q["validate_logins_rejected"] = f"""SELECT c_custkey + 1 AS feed_id,
        'Enter your email and password.' AS errors, 'Enter your email and password.' AS first_error
        FROM customer WHERE {bad_login}"""

    damaged = [*MARKET, DAMAGED]
    rules = {"check_domains": DOMAINS, "check_ranges": RANGES, "check_not_null": NOT_NULL,
             "check_unique": UNIQUE, "check_foreign_keys": FOREIGN_KEYS}
    for name, sql in rules.items():
        q[name] = _sql(damaged, sql)
    everything = "\nUNION ALL ".join(f"({sql})" for sql in [*rules.values(), PRICE_RULE])
    q["check_integrity"] = _sql(damaged, f"""SELECT rule, table_name, count(*) AS violations
        FROM ({everything}) GROUP BY rule, table_name""")

    q["update_audience"] = _sql([BASE, ROOMS, """
        entered AS (SELECT room, from_ts AS ts, 1 AS step FROM stays
                    UNION ALL SELECT room, to_ts, -1 FROM stays WHERE to_ts IS NOT NULL),
        totals AS (SELECT room, ts, sum(sum(step)) OVER (PARTITION BY room ORDER BY ts) AS clients
                   FROM entered GROUP BY room, ts)"""], """SELECT x.id, x.auction_id,
        CAST(coalesce(r.clients, 0) AS BIGINT) AS room_clients,
        CAST(coalesce(e.clients, 0) AS BIGINT) AS all_clients
        FROM (SELECT *, CAST(auction_id AS VARCHAR) AS room, 'all' AS everyone FROM attempts) x
        ASOF LEFT JOIN totals r ON r.room = x.room AND x.created_at >= r.ts
        ASOF LEFT JOIN totals e ON e.room = x.everyone AND x.created_at >= e.ts""")
    q["viewer_sessions"] = _sql([BASE, SESSIONS], f"SELECT {SESSION_COLUMNS} FROM sessions")

    live = [BASE, REPLAY_6H, CLOSED_LIVE]
    q["stream_bids"] = _sql([BASE, REPLAY_6H], OUTCOME_COLUMNS)
    q["stream_close"] = _sql(live, f"""SELECT auction_id, {iso('end_time')} AS end_time, winner_id,
        amount, bid_count FROM live_closed""")
    q["stream_price_ticks"] = _sql([BASE, REPLAY_6H], """SELECT auction_id AS "auctionId",
        max(amount) AS "currentPrice", count(*) AS "bidCount" FROM bids GROUP BY auction_id""")
    q["stream_bid_updates"] = _sql([BASE, REPLAY_6H], """SELECT 'bid' AS type,
        auction_id AS "auctionId", bool_or(extended) AS extended, max(amount) AS "currentPrice",
        least(count(*), 50) AS bids, max(amount) AS highest
        FROM outcomes WHERE outcome = 'ACCEPTED' GROUP BY auction_id""")
    q["stream_closed"] = _sql(live, """SELECT 'closed' AS type, l.auction_id AS "auctionId",
        'closed' AS status, u.first_name || ' ' || left(u.last_name, 1) || '.' AS "winnerName",
        l.current_price AS "currentPrice", l.bid_count AS "bidCount"
        FROM live_closed l LEFT JOIN users u ON u.id = l.winner_id""")
    q["stored_auctions"] = q["settle_auctions"]
    q["stored_transactions"] = q["settle_transactions"]
    q["stored_due_ticks"] = q["settle_auctions"]
    q["stored_erasure"] = q["erase_cascade"]
    q["stream_registrations"] = q["ingest_users"]
    q["stream_registration_outcomes"] = _sql([BASE, FEEDS], """SELECT feed_id,
        CASE WHEN errors <> '' THEN 'INVALID'
             WHEN EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = r.email) OR feed_id >
                  min(feed_id) FILTER (WHERE errors = '') OVER (PARTITION BY email) THEN 'TAKEN'
             ELSE 'REGISTERED' END AS outcome,
        CASE WHEN errors <> '' THEN split_part(errors, ' | ', 1) END AS first_error
        FROM registration_errors r""")
    q["stream_throttle"] = q["replay_login_throttle_3d"]
    q["stream_sessions"] = _sql([BASE, SESSIONS], f"""SELECT {SESSION_COLUMNS} FROM sessions
        WHERE epoch_ms(session_end) + {SIX_HOURS}
              <= (SELECT epoch_ms(max(ts)) - 600000 FROM requests)""")
    q["stream_rooms"] = _sql([BASE, ROOMS], f"""SELECT client_id, room, {iso('from_ts')} AS ts
        FROM stays WHERE to_ts IS NULL""")
    audience = q["update_audience"].removeprefix("WITH " + BASE)
    q["stream_audience"] = (_sql([BASE, REPLAY_6H], "").rstrip() + audience
                            + " WHERE x.id IN (SELECT id FROM bids)")
    q["stream_closed_ticks"] = _sql(
        live, """SELECT 'closed' AS type, auction_id AS "auctionId" FROM live_closed""")
    q["stream_invoices"] = _sql(live, f"""SELECT l.auction_id AS id, l.auction_id,
        l.winner_id AS buyer_id, i.seller_id, l.amount, 'pending' AS status,
        {iso('l.end_time')} AS created_at
        FROM live_closed l JOIN base_auctions a ON a.id = l.auction_id JOIN items i ON i.id = a.item_id
        WHERE l.winner_id IS NOT NULL""")
    for name, base, key, value in (
            ("auction_detail_one", "auction_detail", "auctionId", 2),
            ("bid_history_one", "bid_history_topk", "auctionId", 2),
            ("bids_by_user_one", "bids_by_user", "userId", 3),
            ("listings_by_seller_one", "listings_by_seller", "sellerId", 11),
            ("bids_received_one", "bids_received_topk", "sellerId", 11),
            ("wins_by_buyer_one", "wins_by_buyer", "userId", 3),
            ("transaction_one", "transaction_by_auction", "auctionId", 2),
            ("public_user_one", "public_users", "id", 3)):
        q[name] = f'SELECT * FROM ({q[base]}) WHERE "{key}" = {value}'
    q["bid_messages"] = _messages(f"SELECT id, outcome FROM ({q['replay_bids']})", BID_MESSAGES)
    q["checkout_messages"] = _messages(
        f"SELECT id, outcome FROM ({q['replay_checkout']})", CHECKOUT_MESSAGES)
    return q


# Messages of the refusals.
BID_MESSAGES = {
    "NOT_FOUND": "That auction does not exist.",
    "CLOSED": "This auction has already ended.",
    "OWN_ITEM": "You cannot bid on your own item.",
    "INVALID_AMOUNT": "Enter a valid bid amount in rupees.",
    "TOO_LOW": "Your bid must be higher than the current bid.",
    "BELOW_START": "Your bid must be at least the starting price.",
}
CHECKOUT_MESSAGES = {
    "NOT_FOUND": "No payment is due for that auction.",
    "NOT_WINNER": "Only the winning bidder can complete this payment.",
    "ALREADY_PAID": "This payment has already been completed.",
}


def _messages(judged: str, messages: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in messages.items())
    return f"SELECT id, outcome, CASE outcome {cases} END AS message FROM ({judged})"
