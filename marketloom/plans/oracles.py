"""Plain SQL with the same answers as the registered queries, over the same views."""

from __future__ import annotations

import re

from marketloom.plans.driver_views import VIEWS, sql_views
from marketloom.plans.queries import AS_OF, ORDERED

_ITEM_TEXT = (
    "string_agg(concat_ws(':', i.Oiid, coalesce(CAST(i.Pid AS VARCHAR), '-'), "
    "coalesce(CAST(i.Oquantity AS VARCHAR), '-'), coalesce(CAST(i.Oprice AS VARCHAR), '-'), "
    "coalesce(p.Pname, '-'), coalesce(p.Ppicture, '-')), ',' "
    "ORDER BY i.Oiid, i.Pid, i.Oquantity, i.Oprice, p.Pname, p.Ppicture)"
)
_LISTS = (
    f"lists AS (SELECT i.Oid, {_ITEM_TEXT} AS items FROM s_order_items i "
    "JOIN s_products p ON i.Pid = p.Pid GROUP BY i.Oid)"
)
_NAMES = (
    "names AS (SELECT i.Oid, "
    "string_agg(p.Pname, ', ' ORDER BY i.Oiid, i.Pid, i.Oquantity, i.Oprice) AS products "
    "FROM s_order_items i JOIN s_products p ON i.Pid = p.Pid GROUP BY i.Oid)"
)
_ORDER = "o.Oid, o.Oprice, o.Odate, o.Ostatus, o.Cid, o.Opayment, o.Oslip"
_NESTED = f"""
    SELECT {_ORDER}, coalesce(l.items, '') AS items
    FROM s_orders o LEFT JOIN lists l ON o.Oid = l.Oid WHERE o.Cid IS NOT NULL"""
_PROFILE = (
    "Cid, Cusername, Cstatus, Cname, Caddress, Csubdistrict, Cdistrict, Cprovince, Czipcode, "
    "Cphone, Cdate, Cbirth, Cprofile"
)
_PLACES = """places AS (
    SELECT CAST(10000 + s_nationkey % 20 AS STRING) AS zip_code, s_name AS subdistrict,
           n_name AS district, r_name AS province, s_suppkey AS pos
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _last(changes: str, key: str, where: str = "TRUE") -> str:
    """CTE ``last``: newest change per key."""
    return (
        f"last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) "
        f"AS rn FROM {changes} WHERE {where}) q WHERE rn = 1)"
    )


def _orders_with(status: str, slip: str = "o.Oslip") -> str:
    return (
        f"SELECT o.Oid, o.Oprice, o.Odate, {status} AS Ostatus, o.Cid, o.Opayment, {slip} AS Oslip "
        "FROM s_orders o "
    )


def _set_status(where: str) -> str:
    return f"""{_last('order_log', 'Oid', where)}
        {_orders_with('CASE WHEN l.Oid IS NOT NULL THEN l.status ELSE o.Ostatus END')}
        LEFT JOIN last l ON o.Oid = l.Oid"""


def _customers_with(**columns: str) -> str:
    names = [
        "Cid", "Cname", "Caddress", "Cusername", "Cpassword", "Cphone", "Cstatus", "Cdate",
        "Cbirth", "Csubdistrict", "Cdistrict", "Cprovince", "Czipcode", "Cprofile",
    ]
    return "SELECT " + ", ".join(f"{columns.get(n, 'c.' + n)} AS {n}" for n in names)


# One row per request line with its place in the order, and the verdict per request.
_REQUESTS = """
    lines AS (
        SELECT i.Oid, i.Pid, i.Oquantity, i.Oprice, p.Pstatus,
               row_number() OVER (PARTITION BY i.Oid ORDER BY i.Oiid, i.Pid, i.Oquantity, i.Oprice) - 1 AS pos
        FROM s_order_items i JOIN s_products p ON i.Pid = p.Pid),
    judged AS (
        SELECT o.*, CASE
            WHEN o.Cid IS NULL OR l.Oid IS NULL THEN 'incomplete'
            WHEN o.Oid % 23 < 2 THEN 'unfit: totalPrice'
            WHEN l.unknown > 0 THEN 'bad item' END AS reason
        FROM s_orders o LEFT JOIN (
            SELECT Oid, sum(CASE WHEN Pstatus = 'ECONOMY' OR Pid % 29 = 0 THEN 1 ELSE 0 END) AS unknown
            FROM lines GROUP BY Oid) l ON o.Oid = l.Oid)"""

_FOLD = """
    events_of AS (
        SELECT l.*, o.Oid IS NOT NULL AS known, o.Opayment = 'cod' AS cod, o.Ostatus AS base,
               coalesce(kind IN ('set', 'cancel', 'pay') OR (kind = 'slip' AND o.Opayment <> 'cod'), FALSE) AS setting,
               CASE kind WHEN 'set' THEN l.status WHEN 'cancel' THEN 'cancelled' ELSE 'waiting' END AS new_status
        FROM order_log l LEFT JOIN s_orders o ON l.Oid = o.Oid),
    runs AS (
        SELECT *, sum(CASE WHEN setting THEN 1 ELSE 0 END) OVER (PARTITION BY Oid ORDER BY seq) AS run FROM events_of),
    states AS (
        SELECT *,
               CASE WHEN run = 0 THEN base ELSE max(CASE WHEN setting THEN new_status END) OVER (PARTITION BY Oid, run) END AS held,
               sum(CASE WHEN kind = 'confirm' THEN 1 ELSE 0 END) OVER (PARTITION BY Oid, run ORDER BY seq) AS confirms,
               row_number() OVER (PARTITION BY Oid ORDER BY seq DESC) AS back
        FROM runs),
    urls AS (
        SELECT Oid, url FROM (
            SELECT Oid, url, row_number() OVER (PARTITION BY Oid ORDER BY seq DESC) AS rn
            FROM events_of WHERE kind = 'pay' OR (kind = 'slip' AND NOT cod)) q WHERE rn = 1)"""
_FOLDED = f"""{_FOLD}
    {_orders_with("CASE WHEN s.Oid IS NULL THEN o.Ostatus WHEN s.held = 'shipped' AND s.confirms > 0 THEN 'delivered' ELSE s.held END",
                  "coalesce(u.url, o.Oslip)")}
    LEFT JOIN states s ON o.Oid = s.Oid AND s.back = 1 LEFT JOIN urls u ON o.Oid = u.Oid"""

_DECIDED = f"""{_FOLD}
    SELECT seq, Oid, kind, status, url,
           CASE WHEN NOT known THEN FALSE
                WHEN kind = 'confirm' THEN coalesce(held = 'shipped', FALSE) AND confirms = 1
                WHEN kind = 'slip' THEN NOT cod ELSE TRUE END AS accepted
    FROM states"""

_VALID_REVIEW = "text IS NOT NULL AND round(stars) BETWEEN 1 AND 5"
_REVIEWED = f"""
    added AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY order_id, CASE WHEN order_id IS NULL THEN seq END ORDER BY seq) AS rn
            FROM new_order_reviews WHERE {_VALID_REVIEW}) q
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM s_reviews r WHERE r.order_id = q.order_id))"""

_BAD_NUMBER = "CASE WHEN TRY_CAST({0} AS {1}) IS NULL THEN '{0}' END"
_FAULTS = "concat_ws(',', {})".format(
    ", ".join(
        [
            *[
                f"CASE WHEN {c} IS NULL OR length({c}) > {n} THEN '{c}' END"
                for c, n in (("Pname", 255), ("Pdetail", 1000000000), ("Ppicture", 255), ("Pstatus", 50))
            ],
            _BAD_NUMBER.format("Pprice", "DECIMAL(10,2)"),
            _BAD_NUMBER.format("Pnumproduct", "INTEGER"),
            _BAD_NUMBER.format("Typeid", "BIGINT"),
            _BAD_NUMBER.format("Subtypeid", "BIGINT"),
        ]
    )
)

_TOGGLED = """
    counts AS (
        SELECT customer_id, product_id, count(*) AS toggles, max(seq) AS seq FROM favorite_log
        WHERE customer_id <> 0 AND product_id <> 0 GROUP BY customer_id, product_id),
    present AS (SELECT DISTINCT customer_id, product_id FROM s_favorites)
    SELECT f.id, f.customer_id, f.product_id FROM s_favorites f
    WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.customer_id = f.customer_id AND c.product_id = f.product_id)
    UNION ALL
    SELECT (SELECT max(id) FROM s_favorites) + c.seq, c.customer_id, c.product_id
    FROM counts c LEFT JOIN present p ON c.customer_id = p.customer_id AND c.product_id = p.product_id
    WHERE (p.customer_id IS NOT NULL) <> (c.toggles % 2 = 1)"""

_PAYS = """
    judged AS (
        SELECT n.*, CASE
            WHEN n.Oid IS NULL OR Payprice IS NULL OR Tid IS NULL OR slip IS NULL THEN 'incomplete'
            WHEN TRY_CAST(Payprice AS DECIMAL(10,2)) IS NULL THEN 'unfit: Payprice'
            WHEN o.Oid IS NULL THEN 'unknown order' END AS reason
        FROM new_payments n LEFT JOIN s_orders o ON n.Oid = o.Oid)"""

_ACCOUNTS = """
    judged AS (
        SELECT *, CASE
            WHEN Taccount = '' OR qrcode IS NULL THEN 'incomplete'
            WHEN TRY_CAST(Tnum AS BIGINT) IS NULL OR length(Taccount) > 255 THEN concat('unfit: ', concat_ws(',',
                CASE WHEN TRY_CAST(Tnum AS BIGINT) IS NULL THEN 'Tnum' END,
                CASE WHEN length(Taccount) > 255 THEN 'Taccount' END)) END AS reason
        FROM new_accounts)"""

# Registrations served round by round: a row wins that is the first open one for both its names.
_SERVED = """
    asked AS (
        SELECT *, lower(Cusername) AS u, lower(Cname) AS n FROM registrations
        WHERE Czipcode <> '' AND length(Caddress) <= 255 AND TRY_CAST(Cbirth AS DATE) IS NOT NULL),
    flagged AS (
        SELECT a.*,
               EXISTS (SELECT 1 FROM s_customers c WHERE lower(c.Cusername) = a.u) AS u_taken,
               EXISTS (SELECT 1 FROM s_customers c WHERE lower(c.Cname) = a.n) AS n_taken
        FROM asked a),
    rounds AS (
        SELECT seq, u, n, FALSE AS won FROM flagged WHERE NOT u_taken AND NOT n_taken
        UNION ALL
        SELECT seq, u, n, first FROM (
            SELECT *, max(first) OVER (PARTITION BY u) AS u_gone, max(first) OVER (PARTITION BY n) AS n_gone
            FROM (SELECT seq, u, n, seq = min(seq) OVER (PARTITION BY u)
                         AND seq = min(seq) OVER (PARTITION BY n) AS first
                  FROM rounds WHERE NOT won) x) y
        WHERE first OR NOT (u_gone OR n_gone)),
    served AS (SELECT seq, u FROM rounds WHERE won)"""

_PRODUCT = "Pid, Pname, Pprice, Pnumproduct, Prenume, Pstatus, Ppicture, Pdetail, Typeid, Subtypeid"
_CATALOGUE = """
    SELECT p.*,
           (SELECT t.typenproduct FROM s_product_types t WHERE t.Typeid = p.Typeid) AS typenproduct,
           (SELECT s.subname FROM s_subtypes s WHERE s.Subtypeid = p.Subtypeid) AS subname
    FROM s_products p"""


def _sales_in(when: str) -> str:
    return f"CAST(coalesce(sum(Oprice) FILTER (WHERE {when}), 0) AS DECIMAL(22,2))"


def _bucket(grain: str) -> str:
    return (
        f"SELECT '{grain}' AS grain, CAST(date_trunc('{grain}', Odate) AS DATE) AS bucket, "
        "count(*) AS orders, CAST(sum(Oprice) AS DECIMAL(22,2)) AS sales FROM s_orders GROUP BY 2"
    )


_SQL: dict[str, str] = {
    "q01_orders_with_customer": "SELECT Oid, Oprice, Ostatus, Odate, Cname FROM s_orders JOIN s_customers USING (Cid)",
    "q02_order_items_flat": """
        SELECT o.Oid, o.Oprice AS Ototal, o.Odate, o.Ostatus, o.Cid, o.Opayment, o.Oslip,
               i.Oiid, i.Pid, i.Oquantity, i.Oprice, p.Pname, p.Ppicture
        FROM s_order_items i JOIN s_products p ON i.Pid = p.Pid JOIN s_orders o ON i.Oid = o.Oid
        WHERE o.Cid IS NOT NULL""",
    "q02_customer_orders_nested": f"{_LISTS} {_NESTED}",
    "q03_order_detail": f"""{_LISTS},
        asked AS (SELECT Oid FROM s_orders UNION SELECT order_id FROM s_reviews WHERE order_id IS NOT NULL),
        named AS (SELECT o.*, c.Cname FROM s_orders o JOIN s_customers c ON o.Cid = c.Cid)
        SELECT a.Oid, o.Oprice, o.Odate, o.Ostatus, o.Cid, o.Opayment, o.Oslip, o.Cname,
               coalesce(l.items, '') AS items
        FROM asked a LEFT JOIN named o ON a.Oid = o.Oid LEFT JOIN lists l ON a.Oid = l.Oid""",
    "q04_customer_order_summary": f"""{_NAMES}
        SELECT Oid, Odate, Ostatus, Oprice, products
        FROM s_orders LEFT JOIN names USING (Oid) WHERE Cid IS NOT NULL""",
    "q05_customer_order_summary_strict": f"""{_NAMES}
        SELECT Oid, Odate, Ostatus, Oprice AS Ototal, products
        FROM s_orders JOIN names USING (Oid) WHERE Cid IS NOT NULL""",
    "q06_sales_stats": f"""
        SELECT count(*) AS totalOrders, CAST(sum(Oprice) AS DECIMAL(22,2)) AS totalSales,
               count(*) FILTER (WHERE Ostatus = 'cancelled') AS cancelledOrders,
               count(*) FILTER (WHERE Ostatus = 'failed') AS failedOrders,
               {_sales_in('Odate = d')} AS salesToday,
               {_sales_in("strftime(Odate, '%G-%V') = strftime(d, '%G-%V')")} AS salesThisWeek,
               {_sales_in("strftime(Odate, '%Y-%m') = strftime(d, '%Y-%m')")} AS salesThisMonth
        FROM s_orders, (SELECT DATE '{AS_OF}' AS d) today""",
    "q07_customers_with_order_count": """
        SELECT c.Cid, c.Cname, c.Caddress, c.Cusername, c.Cphone, c.Cstatus, c.Cdate, c.Cbirth,
               c.Csubdistrict, c.Cdistrict, c.Cprovince, c.Czipcode, c.Cprofile,
               CAST((SELECT count(*) FROM s_orders o WHERE o.Cid = c.Cid) AS BIGINT) AS orderCount
        FROM s_customers c WHERE c.Cstatus <> 'deleted'""",
    "q08_product_catalogue": _CATALOGUE,
    "q09_products_by_type": f"{_CATALOGUE} WHERE p.Typeid IN (SELECT Typeid FROM s_product_types)",
    "q10_latest_products": "SELECT * FROM s_products ORDER BY Pid DESC LIMIT 10",
    "q11_product_lookup": """
        SELECT k.key, TRY_CAST(k.key AS BIGINT) IS NOT NULL AS valid, p.Pid IS NOT NULL AS found,
               TRY_CAST(k.key AS BIGINT) AS Pid, p.Pname, p.Pprice, p.Pnumproduct, p.Prenume,
               p.Pstatus, p.Ppicture, p.Pdetail, p.Typeid, p.Subtypeid
        FROM (SELECT DISTINCT key FROM raw_keys) k
        LEFT JOIN s_products p ON TRY_CAST(k.key AS BIGINT) = p.Pid""",
    "q12_product_types": "SELECT * FROM s_product_types",
    "q13_subtypes_of": """
        SELECT Subtypeid, subname FROM s_subtypes
        WHERE Typeid IN (SELECT Typeid FROM s_product_types)""",
    "q14_favorite_products": """
        SELECT customer_id, Pid, Pname, Pprice, Ppicture
        FROM s_products JOIN s_favorites ON product_id = Pid""",
    "q15_recent_reviews": "SELECT id, text, stars FROM s_reviews",
    "q16_reviews_with_order": "SELECT * FROM s_reviews WHERE order_id IN (SELECT Oid FROM s_orders)",
    "q17_review_of_order": """
        SELECT o.Oid AS order_id, r.id IS NOT NULL AS found, r.id, r.text, r.stars, r.created_at
        FROM s_orders o LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY id) AS rn FROM s_reviews
        ) r ON r.order_id = o.Oid AND r.rn = 1""",
    "q18_payments_with_account": """
        SELECT Payid, Oid, Payprice, Paydate, Paystatus, SlipUrl, Tid, Tname, Tnum, Taccount, Tbranch, Tqr
        FROM s_payments JOIN s_transfer USING (Tid)""",
    "q19_payment_of_order": """
        SELECT o.Oid, p.Payid IS NOT NULL AS found, p.Payid, p.Payprice, p.Paydate, p.Paystatus,
               p.SlipUrl, p.Tid, p.Tname, p.Tnum, p.Taccount, p.Tbranch, p.Tqr
        FROM s_orders o LEFT JOIN (
            SELECT p.*, t.Tname, t.Tnum, t.Taccount, t.Tbranch, t.Tqr,
                   row_number() OVER (PARTITION BY p.Oid ORDER BY p.Payid) AS rn
            FROM s_payments p JOIN s_transfer t ON p.Tid = t.Tid
        ) p ON p.Oid = o.Oid AND p.rn = 1""",
    "q20_transfer_accounts": "SELECT * FROM s_transfer",
    "q21_customer_profiles": f"""
        SELECT k.Cid AS key, c.Cid IS NOT NULL AS found, {', '.join('c.' + x for x in _PROFILE.split(', '))}
        FROM (SELECT DISTINCT Cid FROM s_orders WHERE Cid IS NOT NULL) k
        LEFT JOIN s_customers c ON k.Cid = c.Cid""",
    "q21_profiles_by_user_name": f"""
        SELECT k.Cusername AS key, c.Cid IS NOT NULL AS found, {', '.join('c.' + x for x in _PROFILE.split(', '))}
        FROM (SELECT Cusername FROM user_names UNION SELECT Cusername FROM supplier_names) k
        LEFT JOIN s_customers c ON lower(k.Cusername) = lower(c.Cusername)""",
    "q22_enrich_addresses": f"""{_PLACES}
        SELECT c.Cid, c.Czipcode, g.pos IS NOT NULL AS zip_found, g.subdistrict, g.district, g.province
        FROM s_customers c LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY pos) AS rn FROM places
        ) g ON g.zip_code = c.Czipcode AND g.rn = 1""",
    "s1_load_tables": "SELECT * FROM s_products",
    "s2_gazetteer": f"{_PLACES} SELECT zip_code, subdistrict, district, province FROM places",
    "s3_snapshot_roundtrip": "SELECT * FROM s_orders",
    "s4_json_roundtrip": f"{_LISTS} {_NESTED}",
    "m01_set_status": _set_status("kind = 'set'"),
    "m01_set_status_strict": _set_status("kind = 'set' AND status <> ''"),
    "m01_set_status_rejects": """
        SELECT seq, Oid AS key, status, 'no status' AS reason FROM order_log
        WHERE kind = 'set' AND (status IS NULL OR status = '')""",
    "m02_soft_delete_customers": f"""
        {_customers_with(Cstatus="CASE WHEN c.Cid IN (SELECT Cid FROM s_orders WHERE Ostatus = 'failed' AND Cid IS NOT NULL) THEN 'deleted' ELSE c.Cstatus END")}
        FROM s_customers c""",
    "m03_place_orders": f"""{_REQUESTS}
        SELECT Oid + 1 AS seq, (SELECT max(Oid) FROM s_orders) + Oid + 1 AS Oid, Oprice,
               DATE '{ORDERED}' AS Odate,
               CASE WHEN Opayment = 'cod' THEN 'shipped' ELSE 'pending' END AS Ostatus, Cid, Opayment, Oslip
        FROM judged WHERE reason IS NULL""",
    "m03_place_orders_items": f"""{_REQUESTS}
        SELECT Oiid, Oid, Pid, Oquantity, Oprice FROM (
            SELECT (SELECT max(Oiid) FROM s_order_items) + row_number() OVER (ORDER BY l.Oid, l.pos) AS Oiid,
                   (SELECT max(Oid) FROM s_orders) + l.Oid + 1 AS Oid, l.Pid, l.Oquantity, l.Oprice, j.reason
            FROM lines l JOIN judged j ON l.Oid = j.Oid WHERE j.reason IS NULL OR j.reason = 'bad item') q
        WHERE reason IS NULL""",
    "m03_place_orders_rejects": f"""{_REQUESTS}
        SELECT Oid + 1 AS seq, reason FROM judged WHERE reason IS NOT NULL""",
    "m04_attach_slips": f"""{_last('order_log', 'Oid', "kind = 'slip'")}
        {_orders_with("CASE WHEN l.Oid IS NOT NULL AND o.Opayment <> 'cod' THEN 'waiting' ELSE o.Ostatus END",
                      "CASE WHEN l.Oid IS NOT NULL AND o.Opayment <> 'cod' THEN l.url ELSE o.Oslip END")}
        LEFT JOIN last l ON o.Oid = l.Oid""",
    "m04_attach_slips_rejects": """
        SELECT l.seq, l.Oid, l.url,
               CASE WHEN o.Oid IS NULL THEN 'unknown order' ELSE 'paid on delivery' END AS reason
        FROM order_log l LEFT JOIN s_orders o ON l.Oid = o.Oid
        WHERE l.kind = 'slip' AND (o.Oid IS NULL OR o.Opayment = 'cod')""",
    "m05_cancel_orders": _orders_with(
        "CASE WHEN o.Oid IN (SELECT Oid FROM order_log WHERE kind = 'cancel') THEN 'cancelled' ELSE o.Ostatus END"
    ),
    "m06_confirm_orders": _orders_with(
        "CASE WHEN o.Ostatus = 'shipped' AND o.Oid IN (SELECT Oid FROM order_log WHERE kind = 'confirm') "
        "THEN 'delivered' ELSE o.Ostatus END"
    ),
    "m06_confirm_orders_rejects": """
        SELECT l.seq, l.Oid, 'not shipped' AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY Oid ORDER BY seq) AS rn
              FROM order_log WHERE kind = 'confirm') l
        LEFT JOIN s_orders o ON l.Oid = o.Oid
        WHERE NOT coalesce(o.Ostatus = 'shipped' AND l.rn = 1, FALSE)""",
    "m07_fold_order_log": _FOLDED,
    "m07_fold_order_log_decisions": _DECIDED,
    "m08_add_order_reviews": f"""{_REVIEWED}
        SELECT id, text, stars, created_at, order_id FROM s_reviews
        UNION ALL
        SELECT (SELECT max(id) FROM s_reviews) + seq, text, CAST(round(stars) AS INTEGER), TIMESTAMP '{ORDERED} 00:00:00', order_id
        FROM added""",
    "m08_add_order_reviews_rejects": f"""{_REVIEWED}
        SELECT seq, order_id, text, stars,
               CASE WHEN {_VALID_REVIEW} THEN 'already reviewed' ELSE 'invalid' END AS reason
        FROM new_order_reviews WHERE seq NOT IN (SELECT seq FROM added)""",
    "m09_add_reviews": f"""
        SELECT id, text, stars, created_at, order_id FROM s_reviews
        UNION ALL
        SELECT (SELECT max(id) FROM s_reviews) + seq, text, CAST(round(stars) AS INTEGER), TIMESTAMP '{ORDERED} 00:00:00', NULL
        FROM new_reviews WHERE text <> '' AND stars BETWEEN 1 AND 5""",
    "m09_add_reviews_rejects": """
        SELECT seq, text, stars, 'invalid' AS reason FROM new_reviews
        WHERE NOT coalesce(text <> '' AND stars BETWEEN 1 AND 5, FALSE)""",
    "m10_delete_reviews_by_order": """
        SELECT * FROM s_reviews r WHERE NOT EXISTS (
            SELECT 1 FROM s_orders o WHERE o.Oid = r.order_id AND o.Ostatus = 'cancelled')""",
    "m10_delete_reviews_by_id": "SELECT * FROM s_reviews WHERE stars <> 1",
    "m11_add_products": f"""
        SELECT {_PRODUCT} FROM old_products
        UNION ALL
        SELECT (SELECT max(Pid) FROM old_products) + seq, Pname, TRY_CAST(Pprice AS DECIMAL(10,2)), Pnumproduct, 0, Pstatus,
               NULL, NULL, NULL, NULL
        FROM new_products WHERE length(Pname) <= 255 AND TRY_CAST(Pprice AS DECIMAL(10,2)) IS NOT NULL""",
    "m11_add_products_rejects": """
        SELECT * FROM (
            SELECT *, concat('unfit: ', concat_ws(',', CASE WHEN length(Pname) > 255 THEN 'Pname' END,
                CASE WHEN TRY_CAST(Pprice AS DECIMAL(10,2)) IS NULL THEN 'Pprice' END)) AS reason
            FROM new_products) q WHERE reason <> 'unfit: '""",
    "m12_update_products": f"""{_last('product_changes', 'Pid', f"{_FAULTS} = ''")}
        SELECT p.Pid, coalesce(l.Pname, p.Pname) AS Pname,
               coalesce(CAST(l.Pprice AS DECIMAL(10,2)), p.Pprice) AS Pprice,
               coalesce(CAST(l.Pnumproduct AS INTEGER), p.Pnumproduct) AS Pnumproduct, p.Prenume,
               coalesce(l.Pstatus, p.Pstatus) AS Pstatus, coalesce(l.Ppicture, p.Ppicture) AS Ppicture,
               coalesce(l.Pdetail, p.Pdetail) AS Pdetail,
               coalesce(CAST(l.Typeid AS BIGINT), p.Typeid) AS Typeid,
               coalesce(CAST(l.Subtypeid AS BIGINT), p.Subtypeid) AS Subtypeid
        FROM s_products p LEFT JOIN last l ON p.Pid = l.Pid""",
    "m12_update_products_rejects": f"""
        SELECT seq, Pid, {_FAULTS} AS reason FROM product_changes WHERE {_FAULTS} <> ''""",
    "m13_delete_products": "SELECT * FROM s_products WHERE Pstatus <> 'ECONOMY'",
    "m13_delete_products_items": """
        SELECT * FROM s_order_items WHERE Pid NOT IN (SELECT Pid FROM dropped_products)""",
    "m14_toggle_favorites": _TOGGLED,
    "m14_toggle_favorites_rejects": """
        SELECT seq, customer_id, product_id, 'incomplete' AS reason FROM favorite_log
        WHERE customer_id IS NULL OR customer_id = 0 OR product_id IS NULL OR product_id = 0""",
    "m15_record_payments": f"""{_PAYS}
        SELECT Payid, Oid, Payprice, Paydate, Paystatus, SlipUrl, Tid FROM s_payments
        UNION ALL
        SELECT (SELECT max(Payid) FROM s_payments) + seq, Oid, TRY_CAST(Payprice AS DECIMAL(10,2)), TIMESTAMP '{ORDERED} 00:00:00',
               'waiting', concat('/slips/', slip), Tid
        FROM judged WHERE reason IS NULL""",
    "m15_record_payments_orders": f"""{_PAYS}, {_last('judged', 'Oid', 'reason IS NULL')}
        {_orders_with("CASE WHEN l.Oid IS NOT NULL THEN 'waiting' ELSE o.Ostatus END",
                      "CASE WHEN l.Oid IS NOT NULL THEN concat('/slips/', l.slip) ELSE o.Oslip END")}
        LEFT JOIN last l ON o.Oid = l.Oid""",
    "m15_record_payments_rejects": f"""{_PAYS}
        SELECT seq, Oid, Payprice, Tid, slip, reason FROM judged WHERE reason IS NOT NULL""",
    "m16_add_transfer_accounts": f"""{_ACCOUNTS}
        SELECT Tid, Tname, Tnum, Taccount, Tbranch, Tqr FROM s_transfer
        UNION ALL
        SELECT (SELECT max(Tid) FROM s_transfer) + seq, Tname, TRY_CAST(Tnum AS INTEGER), Taccount, Tbranch, concat('/qrs/', qrcode)
        FROM judged WHERE reason IS NULL""",
    "m16_add_transfer_accounts_rejects": f"""{_ACCOUNTS}
        SELECT seq, Tname, Tnum, Taccount, Tbranch, qrcode, reason FROM judged WHERE reason IS NOT NULL""",
    "m17_register_customers": f"""{_SERVED}
        SELECT * FROM s_customers
        UNION ALL
        SELECT (SELECT max(Cid) FROM s_customers) + a.seq, Cname, Caddress, Cusername, Cpassword, Cphone,
               'user', DATE '{ORDERED}', CAST(Cbirth AS DATE), Csubdistrict, Cdistrict, Cprovince, Czipcode, Cprofile
        FROM asked a JOIN served s ON a.seq = s.seq""",
    "m17_register_customers_rejects": f"""{_SERVED}
        SELECT r.*, CASE
            WHEN r.Czipcode = '' THEN 'incomplete'
            WHEN length(r.Caddress) > 255 OR TRY_CAST(r.Cbirth AS DATE) IS NULL THEN concat('unfit: ', concat_ws(',',
                CASE WHEN length(r.Caddress) > 255 THEN 'Caddress' END,
                CASE WHEN TRY_CAST(r.Cbirth AS DATE) IS NULL THEN 'Cbirth' END))
            WHEN f.u_taken OR s.seq < r.seq THEN 'user name taken' ELSE 'name taken' END AS reason
        FROM registrations r LEFT JOIN flagged f ON r.seq = f.seq LEFT JOIN served s ON f.u = s.u
        WHERE r.seq NOT IN (SELECT seq FROM served)""",
    "m18_set_profile_picture": f"""{_last('picture_changes', 'Cid')}
        {_customers_with(Cprofile='CASE WHEN l.Cid IS NOT NULL THEN l.file ELSE c.Cprofile END')}
        FROM s_customers c LEFT JOIN last l ON c.Cid = l.Cid""",
    "c1_duplicate_keys": """
        SELECT Oiid, count(*) AS n FROM s_order_items GROUP BY Oiid HAVING count(*) > 1""",
    "c2_missing_values": "SELECT *, 'Cid' AS missing FROM s_orders WHERE Cid IS NULL",
    "c3_foreign_keys": """
        SELECT * FROM s_reviews r WHERE order_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM s_orders o WHERE o.Oid = r.order_id)""",
    "c4_range": "SELECT * FROM rated_items WHERE stars < 1 OR stars > 5",
    "c5_lengths": """
        SELECT * FROM (
            SELECT *, concat_ws(',', CASE WHEN length(Pname) > 255 THEN 'Pname' END,
                CASE WHEN Pprice >= 100000000 THEN 'Pprice' END) AS too_long
            FROM doc_products) q WHERE too_long <> ''""",
    "c6_product_payload": f"""
        SELECT seq, Pid, {_FAULTS} AS faults FROM product_changes WHERE {_FAULTS} <> ''""",
    "c7_cascade_delete": """
        SELECT * FROM s_payments p WHERE NOT EXISTS (
            SELECT 1 FROM s_orders o WHERE o.Oid = p.Oid AND o.Ostatus = 'cancelled')""",
    "x1_stream_order_status": _FOLDED,
    "x1_stream_order_decisions": _DECIDED,
    "x2_stream_favorites": _TOGGLED,
    "x3_stream_sales": " UNION ALL ".join(_bucket(g) for g in ("day", "week", "month")),
    "x4_stream_first_review": f"{_REVIEWED} SELECT order_id, seq, text, CAST(round(stars) AS INTEGER) AS stars FROM added",
}


def _with_views(sql: str) -> str:
    """Put the views that ``sql`` names in front; a leading ``name AS (...)`` extends the clause."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = sql.strip()
    views = sql_views(used)
    if "FROM rounds" in body:
        views = views.replace("WITH ", "WITH RECURSIVE ", 1)
    if body.upper().startswith("SELECT"):
        return views + body
    return (views.rstrip() + ",\n" if views else "WITH ") + body


def oracle_sql() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in _SQL.items()}
