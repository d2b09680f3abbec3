"""The registered queries as plain SQL for DuckDB, written apart from the Spark code.

``pos_*`` names are the point-of-sale tables; each query gets the ones it mentions as CTEs.
"""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "pos_orders": """
        select o_orderkey as orderID, o_custkey as employeeID, o_orderdate as orderDate,
               cast(o_totalprice as decimal(18,2)) as orderTotal
        from orders""",
    "pos_located": """
        select orderID, employeeID, n_name as orderLocation, orderDate, orderTotal
        from pos_orders join nation on n_nationkey = employeeID % 25""",
    "pos_location": "select n_nationkey as locationID, n_name as locationName from nation",
    "pos_ticks": """
        select event_id as orderID, user_id as employeeID, ts as orderDate,
               cast(case event_type when 'error' then -value when 'view' then 0 else value end
                    as decimal(18,2)) as orderTotal
        from events""",
    "pos_employee": """
        select c_custkey as employeeID, c_name as employeeName,
               case c_mktsegment when 'FURNITURE' then 'Cashier' when 'MACHINERY' then 'Manager'
                    else c_mktsegment end as employeePosition,
               lpad(cast(c_custkey * 7919 % 10000 as varchar), 4, '0') as employeePasscode
        from customer""",
    "pos_line_keys": """
        select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
                  || date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as line_key
        from lineitem""",
    "pos_lines": """
        select line_key as orderItemID, l_partkey as menuID,
               cast(l_extendedprice as decimal(18,2)) as priceAtPurchase,
               cast(l_quantity as decimal(18,2)) as quantityPurchased,
               l_orderkey as orderID, l_linenumber % 3 - 1 as orderSize
        from pos_line_keys""",
    "pos_mods": """
        select line_key || '-' || n as modificationID, l_suppkey as inventoryID,
               line_key as orderItemID, cast(n as decimal(18,2)) as modificationQuantity,
               cast(l_discount as decimal(18,2)) as cost
        from (select *, unnest(range(1, l_linenumber % 3 + 1)) as n from pos_line_keys)""",
    "pos_menu": """
        select p_partkey as menuID, p_name as menuName, p_type as category,
               cast(p_retailprice as decimal(18,2)) as price, p_size as menuImage,
               p_brand as menuDescription,
               case when p_partkey % 10 = 0 then null
                    else cast(make_date(2024, p_size % 12 + 1, 1) as timestamp) end as seasonalStart,
               cast(make_date(2024, cast((p_size + p_partkey) % 12 + 1 as int), 15) as timestamp)
                   as seasonalEnd
        from part""",
    "pos_inventory": """
        select s_suppkey as inventoryID, s_name as inventoryName,
               cast(s_acctbal as decimal(18,2)) as quantityAvailable,
               cast(s_suppkey % 7 - 3 as int) as restockOrdered, n_name as unit,
               2000 as restockMin
        from supplier join nation on s_nationkey = n_nationkey""",
    "pos_recipe": """
        select distinct l_partkey as menuID, l_suppkey as inventoryID,
               cast(l_suppkey % 5 + 1 as decimal(18,2)) as menuInfoQuantity
        from lineitem""",
    "pos_new_menu": """
        select -menuID - 1 as menuID, menuName, category, price, menuImage, menuDescription,
               seasonalStart, seasonalEnd
        from pos_menu""",
    "pos_cart_events": """
        select user_id as order_id, ts as orderDate, event_type = 'error' as removing,
               event_id % 5 as drink,
               cast(event_id % 5 as decimal(18,2)) + cast(4.65 as decimal(18,2)) as price
        from events""",
    "pos_carts": """
        select order_id,
               cast(sum(greatest(adds - removes, 0)) as bigint) as n_lines,
               sum(greatest(adds - removes, 0) * price) as total
        from (select order_id, price, count(*) filter (where not removing) as adds,
                     count(*) filter (where removing) as removes
              from pos_cart_events group by order_id, price)
        group by order_id""",
    "pos_rotation": """
        select employeeID, row_number() over (order by employeeID) - 1 as turn,
               count(*) over () as turns
        from pos_employee where employeePosition = 'Cashier' and employeeID between 0 and 29""",
    "pos_date_text": """
        select orderID, orderDate,
               case orderID % 7
                    when 0 then strftime(orderDate, '%Y %m %d')
                    when 1 then strftime(orderDate, '%Y/%m/%d')
                    when 2 then strftime(orderDate, '%Y-%m-%d')
                    when 3 then strftime(orderDate, '%d.%m.%Y')
                    when 4 then strftime(orderDate, '%Y-13-%d')
                    when 5 then ' ' || strftime(orderDate, '%Y-%m-31') || ' '
                    else '   ' end as text
        from pos_orders""",
}

# Money over a range of averages: exact half-up rounding in whole cents.
_AVERAGE = "cast((cast({sum} * 100 as hugeint) * 2 + {n}) // (2 * {n}) as double) / 100"


def _season(day: int) -> str:
    start, end = "month(seasonalStart) * 100 + day(seasonalStart)", "month(seasonalEnd) * 100 + day(seasonalEnd)"
    return f"""case when seasonalStart is null or seasonalEnd is null then true
                    when month(seasonalEnd) < month(seasonalStart) then {day} >= {start} or {day} <= {end}
                    else {day} >= {start} and {day} <= {end} end"""


_STATS = """
    select count(*) as n_rows,
           count(nullif(orderTotal, 0)) as n_nonzero,
           cast(sum(orderTotal) as double) as sum_total,
           cast(coalesce(sum(orderTotal), 0) as double) as sum_or_zero,
           cast(sum(orderTotal * orderTotal) as double) as sum_square,
           case when count(*) > 0 then {average} end as avg_total,
           cast(round(sum(orderTotal), 2) as double) as sum_rounded,
           min(orderDate) as first_order, max(orderDate) as last_order,
           cast(coalesce(sum(orderTotal) filter (where orderTotal < 0), 0) as double) as returns,
           count(*) filter (where orderTotal = 0) as voids
    from pos_ticks""".format(average=_AVERAGE.format(sum="sum(orderTotal)", n="count(*)"))

_APPENDED = """
    select numbered.id as orderID, r.employeeID, {location}, orderDate, cast(total as double) as orderTotal
    from (select *, (select max(orderID) from pos_orders) + row_number() over (order by {order}) as id,
                 ((select count(*) from pos_orders) + row_number() over (order by {order}) - 1)
                     % (select count(*) from pos_rotation) as my_turn
          from {carts}) numbered
    join pos_rotation r on r.turn = numbered.my_turn"""

_TICK_CARTS = "(select orderID as order_id, orderDate, orderTotal as total from pos_ticks)"
_BY_TIME = "orderDate, order_id, total"
_HERE = "'College Station' as orderLocation"
_EXISTING = "select orderID, employeeID, orderLocation, orderDate, cast(orderTotal as double) as orderTotal from pos_located"

QUERIES: dict[str, str] = {
    "q01_weekly_orders": """
        select cast(week(orderDate) as int) as week_number, count(*) as total_orders
        from pos_orders group by 1""",
    "q02_hourly_sales": """
        select cast(hour(orderDate) as int) as hour_of_day, count(*) as total_orders,
               cast(sum(orderTotal) as double) as total_sales
        from pos_ticks group by 1""",
    "q03_peak_days": """
        select cast(orderDate as date) as sales_day, cast(sum(orderTotal) as double) as total_sales
        from pos_orders group by 1 order by sum(orderTotal) desc, 1 limit 10""",
    "q04_recipe_size": """
        select menuName, count(r.inventoryID) as inventory_items_used
        from pos_recipe r join pos_menu m on r.menuID = m.menuID group by 1""",
    "q05_worst_day_top_seller": """
        , per_item as (
            select cast(orderDate as date) as d, menuName, sum(quantityPurchased) as q
            from pos_orders join pos_lines using (orderID) join pos_menu using (menuID)
            where week(orderDate) = 26 group by all),
        leaders as (
            select d, arg_min(menuName, (-q, menuName)) as item, max(q) as q from per_item group by d),
        days as (
            select cast(orderDate as date) as d, sum(orderTotal) as s,
                   row_number() over (order by sum(orderTotal), cast(orderDate as date)) as place
            from pos_orders where week(orderDate) = 26 group by 1)
        select strftime(d, '%d ') || rpad(monthname(d), 9, ' ') as lowest_sales_day, cast(s as double) as total_sales,
               item as top_seller, cast(q as double) as total_quantity
        from days join leaders using (d) where place = 1""",
    "q06_orders_with_employee": """
        select orderID, employeeName, orderDate, cast(orderTotal as double) as orderTotal
        from pos_orders join pos_employee using (employeeID)""",
    "q07_orders_per_location": """
        select locationName, count(orderID) as numOrders
        from pos_located join pos_location on orderLocation = locationName group by 1""",
    "q08_mods_per_line": """
        select l.orderItemID, menuName, count(modificationID) as totalModifications,
               cast(sum(cost) as double) as extraCost
        from pos_lines l join pos_mods d on l.orderItemID = d.orderItemID
        join pos_menu m on l.menuID = m.menuID group by 1, 2""",
    "q09_quantity_by_item": """
        select menuName, cast(sum(quantityPurchased) as double) as totalPurchased
        from pos_lines join pos_menu using (menuID) group by 1""",
    "q10_avg_order_by_employee": f"""
        select employeeName, count(orderID) as total_orders,
               {_AVERAGE.format(sum="sum(orderTotal)", n="count(orderTotal)")} as avg_order_value
        from pos_orders join pos_employee using (employeeID) group by 1""",
    "q11_revenue_by_category": """
        select category, count(orderItemID) as items_sold,
               cast(sum(quantityPurchased * priceAtPurchase) as double) as total_revenue
        from pos_lines join pos_menu using (menuID) group by 1""",
    "q12_sales_by_weekday": """
        select rpad(dayname(orderDate), 9, ' ') as day_of_week, count(orderID) as total_orders,
               cast(round(sum(orderTotal), 2) as double) as total_sales
        from pos_orders group by 1""",
    "q13_largest_orders": """
        select orderID as orderid, orderDate as orderdate, cast(round(orderTotal, 2) as double) as ordertotal
        from pos_orders order by pos_orders.orderTotal desc, orderID, orderDate limit 10""",
    "q13_largest_orders_demo": """
        select orderID as orderid, orderDate as orderdate, cast(round(orderTotal, 2) as double) as ordertotal
        from pos_orders order by pos_orders.orderTotal desc, orderID, orderDate limit 5""",
    "q14_addon_revenue": """
        select inventoryName, cast(sum(cost * modificationQuantity) as double) as total_revenue_from_addon
        from pos_mods join pos_inventory using (inventoryID) group by 1""",
    "q15_revenue_by_employee": """
        select employeeName, cast(sum(orderTotal) as double) as total_revenue
        from pos_employee join pos_orders using (employeeID) group by 1""",
    "q16_top_orders_by_lines": """
        select o.orderID, orderDate, cast(sum(quantityPurchased * priceAtPurchase) as double) as order_revenue,
               count(orderItemID) as num_items
        from pos_orders o join pos_lines l on o.orderID = l.orderID group by 1, 2
        order by sum(quantityPurchased * priceAtPurchase) desc, 1, 2 limit 5""",
    "q17_avg_items_by_employee": f"""
        select employeeName, {_AVERAGE.format(sum="sum(quantityPurchased)", n="count(distinct orderID)")} as avg_items_per_order
        from pos_lines join (select distinct orderID, employeeID from pos_orders) using (orderID)
        join pos_employee using (employeeID) group by employeeName""",
    "q18_mod_revenue_by_item": """
        select menuName, cast(sum(cost) as double) as total_modification_revenue
        from pos_lines l join pos_menu m on l.menuID = m.menuID
        join pos_mods d on l.orderItemID = d.orderItemID group by 1""",
    "r01_inventory_view": """
        select inventoryName as "Ingredient", cast(quantityAvailable as double) as "Quantity", unit as "Unit"
        from pos_inventory""",
    "r02_order_history": """
        select orderID as "Order ID", employeeID as "Employee ID", orderLocation as "Location",
               orderDate as "Date", cast(orderTotal as double) as "Total ($)"
        from pos_located order by orderDate desc, orderID, employeeID, orderTotal limit 40""",
    "r03_employee_view": """
        select employeeID as "ID", employeeName as "Name", employeePosition as "Position" from pos_employee""",
    "r04_menu_view": """
        select menuID as "ID", menuName as "Name", category as "Category", cast(price as double) as "Price ($)",
               menuDescription as "Description" from pos_menu""",
    "r05_restock_status": """
        select inventoryName as "Ingredient", cast(quantityAvailable as double) as "Quantity Available",
               restockMin as "Restock Min", if(quantityAvailable <= restockMin, 'Y', 'N') as "Restock: Y/N"
        from pos_inventory""",
    "r06_range_totals": """
        select cast(coalesce(sum(orderTotal), 0) as double) as totalRevenue, count(*) as totalOrders
        from pos_orders where orderDate >= timestamp '1998-01-01' and orderDate < timestamp '1998-02-01'""",
    "r07_top_items": """
        , revenue as (
            select menuName as itemName, sum(quantityPurchased * priceAtPurchase) as r
            from pos_lines l join pos_menu m on m.menuID = l.menuID join pos_orders o on o.orderID = l.orderID
            where orderDate >= timestamp '1998-01-01' and orderDate < timestamp '1998-02-01'
            group by 1 order by 2 desc, 1 limit 5)
        select itemName, cast(r as double) as totalRevenue,
               format('${:,.2f}', cast(round(r, 2) as double)) as revenueFormatted from revenue""",
    "r08_window_top_items": """
        , revenue as (
            select menuName as itemName, sum(quantityPurchased * priceAtPurchase) as r
            from pos_lines l join pos_menu m on m.menuID = l.menuID join pos_orders o on o.orderID = l.orderID
            where orderDate >= timestamp '1997-03-01 06:30:00' and orderDate < timestamp '1997-09-01 18:00:00'
            group by 1 order by 2 desc, 1 limit 5)
        select itemName, cast(r as double) as totalRevenue,
               format('${:,.2f}', cast(round(r, 2) as double)) as revenueFormatted from revenue""",
    "r08_window_totals": """
        select cast(coalesce(sum(orderTotal), 0) as double) as totalRevenue, count(*) as totalOrders
        from pos_ticks
        where orderDate >= timestamp '2024-01-10 09:00:00' and orderDate < timestamp '2024-01-12 17:00:00'""",
    "f13_reversed_range": """
        select cast(coalesce(sum(orderTotal), 0) as double) as totalRevenue, count(*) as totalOrders
        from pos_ticks where orderDate >= timestamp '2024-01-12' and orderDate < timestamp '2024-01-10'""",
    "r09_x_report_hourly": """
        select lpad(cast(hour(orderDate) as varchar), 2, '0') || ':00' as hour,
               cast(sum(orderTotal) as double) as totalSales
        from pos_ticks where cast(orderDate as date) = date '2024-01-10' group by 1""",
    "r10_x_report_totals": """
        select cast(coalesce(sum(orderTotal), 0) as double) as totalSales,
               cast(abs(coalesce(sum(orderTotal) filter (where orderTotal < 0), 0)) as double) as totalReturns,
               count(*) filter (where orderTotal = 0) as voidCount
        from pos_ticks where cast(orderDate as date) = date '2024-01-10'""",
    "r11_discards": """
        select cast(coalesce(sum(restockOrdered), 0) as bigint) as totalDiscards,
               'Discards: ' || cast(coalesce(sum(restockOrdered), 0) as bigint) || ' items' as label
        from pos_inventory where restockOrdered > 0""",
    "r12_z_report": """
        select cast(coalesce(sum(orderTotal), 0) as double) as totalSales, count(orderID) as totalOrders,
               min(orderDate) as firstOrder, max(orderDate) as lastOrder, cast(0 as double) as discounts,
               cast(0 as double) as voids, cast(0 as double) as "serviceCharges"
        from pos_ticks where cast(orderDate as date) = date '2024-01-10'""",
    "r13_ingredient_usage": """
        select inventoryName as ingredient, unit,
               cast(round(sum(menuInfoQuantity * quantityPurchased), 2) as double) as totalUsed,
               inventoryName || ' (' || unit || ')' as label
        from pos_orders o join pos_lines l on o.orderID = l.orderID
        join pos_recipe r on l.menuID = r.menuID join pos_inventory i on r.inventoryID = i.inventoryID
        where orderDate between timestamp '1998-01-01' and timestamp '1998-02-01' group by 1, 2""",
    "r14_available_menu": f"""
        select menuName, cast(price as double) as price, menuImage from pos_menu
        where category = 'PROMO' and {_season(1120)}""",
    "f02_order_flags": """
        select orderID,
               orderDate >= timestamp '2024-01-10' and orderDate < timestamp '2024-01-15' as in_range,
               orderDate between timestamp '2024-01-10' and timestamp '2024-01-15' as in_closed_range,
               cast(orderDate as date) = date '2024-01-10' as on_day,
               week(orderDate) = 2 as in_week, orderTotal < 0 as is_return, orderTotal = 0 as is_void
        from pos_ticks""",
    "f03_closed_range_orders": """
        select orderID, orderDate,
               orderDate >= timestamp '1998-01-01' and orderDate < timestamp '1998-02-01' as in_range,
               orderDate between timestamp '1998-01-01' and timestamp '1998-02-01' as in_closed_range
        from pos_orders""",
    "f09_rotation_cashiers": """
        select employeeID, employeePosition,
               employeePosition = 'Cashier' and employeeID between 0 and 29 as on_rotation
        from pos_employee""",
    "f10_in_season": f"""
        select menuID, category = 'PROMO' as is_promo, {_season(101)} as in_season_jan,
               {_season(515)} as in_season_may, {_season(1120)} as in_season_nov
        from pos_menu""",
    "f11_stock_flags": """
        select inventoryID, restockOrdered > 0 as pending, if(quantityAvailable <= restockMin, 'Y', 'N') as low
        from pos_inventory""",
    "f12_login_audit": """
        , attempts as (
            select c_custkey as attempt_id, employeePosition as role,
                   lpad(cast((c_custkey * 7919 + if(c_acctbal < 0, 1, 0)) % 10000 as varchar), 4, '0') as code
            from customer join pos_employee on employeeID = c_custkey)
        select attempt_id, role,
               exists (select 1 from pos_employee e
                       where e.employeePosition = a.role and e.employeePasscode = a.code) as granted
        from attempts a""",
    "f14_non_empty_orders": """
        , per_drink as (
            select order_id || '/Drink ' || drink || ' [] - $' || cast(price as varchar) as order_id, price,
                   count(*) filter (where not removing) - count(*) filter (where removing) as kept
            from pos_cart_events group by order_id, drink, price)
        select order_id, kept as n_lines, cast(kept * price as double) as total from per_drink where kept > 0""",
    "j02_orders_with_location": """
        select orderID, locationID, locationName, cast(orderTotal as double) as orderTotal
        from pos_located join pos_location on orderLocation = locationName""",
    "j03_lines_with_menu": """
        select orderItemID, menuName, category, cast(quantityPurchased as double) as quantityPurchased
        from pos_lines join pos_menu using (menuID)""",
    "j04_lines_with_mods": """
        select modificationID, l.orderItemID, orderID, menuName, cast(cost as double) as cost
        from pos_lines l join pos_mods d on l.orderItemID = d.orderItemID join pos_menu m on l.menuID = m.menuID""",
    "j05_mods_with_inventory": """
        select modificationID, inventoryName, unit, cast(modificationQuantity as double) as modificationQuantity,
               cast(cost as double) as cost
        from pos_mods join pos_inventory using (inventoryID)""",
    "j06_recipe_with_menu": """
        select menuID, inventoryID, menuName, cast(menuInfoQuantity as double) as menuInfoQuantity
        from pos_recipe join pos_menu using (menuID)""",
    "j07_orders_with_lines": """
        select o.orderID, orderItemID, orderDate, cast(priceAtPurchase as double) as priceAtPurchase
        from pos_orders o join pos_lines l on o.orderID = l.orderID""",
    "j08_orders_with_item_counts": """
        select orderID, employeeName, cast(total_items as double) as total_items
        from pos_orders join pos_employee using (employeeID)
        join (select orderID, sum(quantityPurchased) as total_items from pos_lines group by 1) using (orderID)""",
    "j09_sold_items": """
        select orderItemID, orderDate, menuName, cast(priceAtPurchase as double) as priceAtPurchase
        from pos_lines join pos_menu using (menuID) join pos_orders using (orderID)""",
    "j10_used_ingredients": """
        select r.menuID, r.inventoryID, inventoryName, cast(sold as double) as quantitySold,
               cast(menuInfoQuantity as double) as menuInfoQuantity
        from (select menuID, sum(quantityPurchased) as sold from pos_lines join pos_orders using (orderID) group by 1) s
        join pos_recipe r on r.menuID = s.menuID join pos_inventory i on i.inventoryID = r.inventoryID""",
    "j11_orders_on_best_days": """
        , best as (
            select cast(orderDate as date) as sale_day from pos_orders group by 1
            order by sum(orderTotal) desc, 1 limit 10)
        select orderID, sale_day, cast(orderTotal as double) as orderTotal
        from pos_orders join best on cast(orderDate as date) = sale_day""",
    "j12_best_and_worst_day": """
        , daily as (select cast(orderDate as date) as d, sum(orderTotal) as s from pos_orders group by 1)
        select b.d as best_day, cast(b.s as double) as best_sales, w.d as worst_day, cast(w.s as double) as worst_sales
        from (select * from daily order by s desc, d limit 1) b, (select * from daily order by s, d limit 1) w""",
    "a01_order_stats": "",
    "a05_empty_order_stats": "",
    "a09_next_id": "select coalesce(max(orderID), 0) + 1 as next_id from pos_orders",
    "a10_sales_by_period": """
        select cast(week(orderDate) as int) as week_number, cast(orderDate as date) as sales_day,
               rpad(dayname(orderDate), 9, ' ') as day_of_week, count(*) as total_orders,
               cast(sum(orderTotal) as double) as total_sales
        from pos_ticks group by 1, 2, 3""",
    "a12_item_counts_by_key": """
        select m.menuID, menuName, category, count(*) as n_lines
        from pos_lines l join pos_menu m on l.menuID = m.menuID group by 1, 2, 3""",
    "a14_grand_total": """
        select cast(coalesce(sum(orderTotal), 0) as double) as totalSales
        from pos_ticks where cast(orderDate as date) = date '2024-01-10'""",
    "o05_nth_employee": """
        , ranked as (select employeeID, employeeName, row_number() over (order by employeeID) - 1 as place
                     from pos_employee)
        select employeeID, employeeName from ranked
        where place = (select count(*) from pos_orders) % (select count(*) from pos_employee)""",
    "x01_time_parts": """
        select orderID, cast(week(orderDate) as int) as week, cast(hour(orderDate) as int) as hour,
               cast(orderDate as date) as day, rpad(dayname(orderDate), 9, ' ') as weekday,
               strftime(orderDate, '%d ') || rpad(monthname(orderDate), 9, ' ') as day_month,
               cast(cast(orderDate as date) - interval 7 day as date) as week_before,
               cast(month(orderDate) * 100 + day(orderDate) as int) as month_day,
               if(orderTotal <> 0, strftime(orderDate, '%Y-%m-%d %H:%M:00.0'), 'None') as minute_label
        from pos_ticks""",
    "x08_money_labels": """
        select orderID, format('${:,.2f}', cast(orderTotal as double)) as money,
               format('Total: ${:.2f}', cast(orderTotal as double)) as total,
               lpad(cast(hour(orderDate) as varchar), 2, '0') || ':00' as hour,
               'Discards: ' || orderID || ' items' as items,
               cast(abs(orderTotal) as double) as absolute,
               cast(round(orderTotal * cast(1.075 as decimal(4,3)), 2) as double) as with_tax,
               cast(coalesce(nullif(orderTotal, 0), -1) as double) as non_zero
        from pos_ticks""",
    "x13_text_labels": """
        select menuID, menuName || ' (' || if(menuImage > 25, category, 'null') || ')' as unit,
               menuName || ' - $' || cast(price as varchar) as line, cast(price as double) as price_again,
               menuName as trimmed
        from pos_menu""",
    "x16_normalise_dates": """
        select orderID,
               case orderID % 7 when 3 then null when 4 then null when 6 then null
                    when 5 then last_day(orderDate) else cast(orderDate as date) end as day
        from pos_date_text""",
    "x17_iso_dates": """
        select orderID, case when orderID % 7 = 2 then cast(text as date) end as day from pos_date_text""",
    "x18_parsed_numbers": """
        select orderID,
               cast(case orderID % 4 when 0 then employeeID when 1 then -employeeID end as int) as number,
               cast(case orderID % 4 when 0 then employeeID when 1 then -employeeID
                    when 2 then orderTotal end as double) as amount
        from pos_orders""",
    "x18_employee_form": """
        select if(employeeID % 3 = 0, '12a', cast(employeeID as varchar)) as employeeID,
               if(employeeID % 5 = 0, ' ', employeeName) as employeeName, employeePosition,
               array_to_string(list_filter([if(employeeID % 3 = 0, 'employeeID', ''), if(employeeID % 5 = 0, 'employeeName', ''),
                   if(employeeID % 7 = 0, 'employeePasscode', '')], lambda x: x <> ''), ', ') as problems
        from pos_employee where employeeID % 3 = 0 or employeeID % 5 = 0 or employeeID % 7 = 0""",
    "x18_menu_change_form": """
        select cast(menuID + 3000000000 as varchar) as menuID, menuName, if(menuID % 5 = 0, '', category) as category,
               if(menuID % 3 = 0, '$4', cast(price as varchar)) as price,
               if(menuID % 5 = 0, if(menuID % 3 = 0, 'category, price', 'category'), 'price') as problems
        from pos_menu where menuID % 3 = 0 or menuID % 5 = 0""",
    "x18_restock_form": """
        select inventoryName, '1.5' as addAmount, 'addAmount' as problems from pos_inventory where inventoryID % 3 = 0""",
    "s01_order_feed": _EXISTING,
    "s02_menu_feed": """
        select menuID, menuName || ', "' || menuDescription || '"' as menuName, category,
               cast(price as double) as price, menuImage, 'None' as menuDescription, seasonalStart, seasonalEnd
        from pos_menu""",
    "s03_staged_load": """
        select 'menu' as table_name, count(*) as n_rows, count(distinct menuID) as n_keys,
               cast(sum(price) as double) as total from pos_menu
        union all select 'employee', count(*), count(distinct employeeID), cast(sum(employeeID) as double) from pos_employee
        union all select 'ordertest', count(*), count(distinct orderID), cast(sum(orderTotal) as double) from pos_located
        union all select 'inventory', count(*), count(distinct inventoryID), cast(sum(quantityAvailable) as double)
        from pos_inventory
        union all select 'locationTable', count(*), count(distinct locationID), cast(sum(locationID) as double)
        from pos_location""",
    "s04_table_versions": """
        select menuID, menuName, category, cast(price as double) as price, menuImage, menuDescription, seasonalStart,
               seasonalEnd from pos_menu""",
    "s05_create_and_drop": """
        select 'menu' as table_name, count(*) as n_rows, false as is_left from pos_menu
        union all select 'employee', count(*), false from pos_employee
        union all select 'ordertest', count(*), false from pos_located
        union all select 'inventory', count(*), false from pos_inventory
        union all select 'locationTable', count(*), false from pos_location
        union all select unnest(['orderItem', 'modification', 'menuInfo']), 0, false""",
    "s08_display": """
        select cast(orderID as varchar) as orderID, cast(employeeID as varchar) as employeeID,
               cast(orderTotal as varchar) as orderTotal from pos_ticks""",
    "w01_upsert_menu": """
        select menuID, if(menuImage % 2 = 0, 'new ' || menuName, menuName) as menuName, category,
               cast(if(menuImage % 2 = 0, price + 1, price) as double) as price, menuImage, menuDescription,
               seasonalStart, seasonalEnd
        from pos_menu
        union all
        select menuID, 'new ' || menuName, category, cast(price + 1 as double), menuImage, menuDescription,
               seasonalStart, seasonalEnd
        from pos_new_menu where menuImage % 2 <> 0""",
    "w02_insert_employees": """
        select employeeID, employeeName, employeePosition from pos_employee
        union all select -employeeID - 1, employeeName, employeePosition from pos_employee""",
    "w03_insert_menu_items": """
        select menuID, menuName, category, cast(price as double) as price, menuImage, menuDescription,
               seasonalStart, seasonalEnd from pos_menu
        union all
        select menuID, menuName, category, cast(price as double), null, menuDescription,
               if(menuImage % 2 = 0, timestamp '2024-01-01', timestamp '2024-03-01'),
               if(menuImage % 2 = 0, timestamp '2024-12-31', seasonalEnd)
        from pos_new_menu""",
    "w04_update_menu": """
        select menuID, if(menuImage % 2 = 0, 'new ' || menuName, menuName) as menuName,
               if(menuImage % 2 = 0, 'NEW ' || category, category) as category,
               cast(if(menuImage % 2 = 0, price * 2, price) as double) as price, menuImage, menuDescription,
               seasonalStart, seasonalEnd
        from pos_menu""",
    "w05_restock": """
        , deltas as (
            select 'Supplier#' || lpad(cast(user_id as varchar), 9, '0') as inventoryName, sum(event_id % 7 - 2) as d
            from events group by 1)
        select inventoryID, i.inventoryName, cast(quantityAvailable + coalesce(d, 0) as double) as quantityAvailable,
               restockOrdered, unit, restockMin
        from pos_inventory i left join deltas x on x.inventoryName = i.inventoryName""",
    "w06_delete_employees": """
        select employeeID, employeeName, employeePosition from pos_employee
        where exists (select 1 from orders where o_custkey = employeeID)""",
    "w07_delete_menu_items": """
        select menuID, menuName, category, cast(price as double) as price, menuImage, menuDescription,
               seasonalStart, seasonalEnd
        from pos_menu where exists (select 1 from lineitem where l_partkey = menuID)""",
    "w08_append_orders": _EXISTING + " union all " + _APPENDED.format(location=_HERE, carts=_TICK_CARTS, order=_BY_TIME),
    "w10_pk_violations": """
        select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1""",
    "w11_fk_violations": """
        select o_custkey, count(*) as n_rows from orders
        where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal >= 0) group by 1""",
    "c01_customise": """
        select line_key as line,
               l_returnflag || ' ['
               || if(l_partkey % 2 = 1, '-Milk ', '') || if(l_partkey // 2 % 2 = 1, '-Sugar ', '')
               || if(l_partkey // 4 % 2 = 1, '-Boba ', '') || if(l_partkey // 8 % 2 = 1, '-Ice ', '')
               || if(l_suppkey % 2 = 1, '+Aloe ', '') || if(l_suppkey // 2 % 2 = 1, '+Pudding ', '')
               || if(l_suppkey // 4 % 2 = 1, '+Jelly ', '') || if(l_suppkey // 8 % 2 = 1, '+Extra Boba ', '')
               || ']' as description,
               l_quantity + 0.5 * bit_count(l_suppkey % 16) as price
        from pos_line_keys""",
    "c02_order_totals": """
        select orderID as order_id, cast(sum(priceAtPurchase) as double) as total,
               format('Total: ${:.2f}', cast(sum(priceAtPurchase) as double)) as label
        from pos_lines group by 1""",
    "c03_cart_totals": "select order_id, n_lines, cast(total as double) as total from pos_carts",
    "c04_submit_orders": _EXISTING + " union all " + _APPENDED.format(
        location=_HERE,
        order=_BY_TIME,
        carts="""(select order_id, total, orderDate from pos_carts
                  join (select order_id, max(orderDate) as orderDate from pos_cart_events group by 1) using (order_id)
                  where n_lines > 0)""",
    ),
    "g01_price_on": """
        select orderItemID, menuID,
               cast(price + 0.25 * (date_diff('day', date '1992-01-01', cast(orderDate as date)) // 91 + 1) as double)
                   as price_then
        from pos_lines join pos_orders using (orderID) join pos_menu using (menuID)""",
    "g02_peak_days": """
        select orderID, orderDate,
               cast(orderDate as date) in (date '1996-02-29', date '1998-01-15', date '1994-07-04') as is_peak
        from pos_orders""",
    "g03_line_price": """
        , addons as (select orderItemID, sum(cost) as c from pos_mods group by 1)
        select l.orderItemID, l.menuID,
               cast(floor((price + coalesce(c, 0) + cast(0.5 as decimal(18,2)) * orderSize) * quantityPurchased * 100)
                    as double) / 100 as linePrice
        from pos_lines l join pos_menu m on l.menuID = m.menuID left join addons a on a.orderItemID = l.orderItemID""",
    "g04_reconcile_totals": """
        , sums as (select orderID, sum(priceAtPurchase) as s from pos_lines group by 1)
        select o.orderID, cast(orderTotal as double) as header, cast(coalesce(s, 0) as double) as lines,
               cast(orderTotal - coalesce(s, 0) as double) as diff
        from pos_orders o left join sums on sums.orderID = o.orderID where orderTotal <> coalesce(s, 0)""",
    "g05_roster": """
        select orderID, cast(date_diff('day', date '1992-01-01', cast(orderDate as date)) % 3 + 1 as int) as onDuty
        from pos_orders""",
    "g06_running_sales": """
        , days as (select cast(orderDate as date) as sales_day, sum(orderTotal) as s from pos_orders group by 1)
        select sales_day, cast(s as double) as daySales,
               cast(sum(s) over (order by sales_day rows unbounded preceding) as double) as totalSales
        from days""",
    "t01_order_intake": _APPENDED.format(location=_HERE, carts=_TICK_CARTS, order="order_id % 4, " + _BY_TIME),
    "t02_live_hourly_sales": """
        select date_trunc('hour', orderDate) as hourStart, cast(sum(orderTotal) as double) as totalSales,
               count(*) as totalOrders
        from pos_ticks group by 1""",
    "t03_live_day_totals": """
        select cast(orderDate as date) as day, cast(sum(orderTotal) as double) as totalSales,
               count(orderID) as totalOrders, min(orderDate) as firstOrder, max(orderDate) as lastOrder
        from pos_ticks group by 1""",
}
_EMPTY_AVERAGE = _STATS + " where orderDate >= timestamp '2030-01-01' and orderDate < timestamp '2030-02-01'"
QUERIES["a01_order_stats"] = _STATS
# Other ways to the rows of a query above.
QUERIES["r08_rollup_totals"] = QUERIES["r08_window_totals"]
QUERIES["r08_rollup_top_items"] = QUERIES["r08_window_top_items"]
QUERIES["r13_rollup_usage"] = QUERIES["r13_ingredient_usage"]
QUERIES["j07_colocated"] = QUERIES["j07_orders_with_lines"]
QUERIES["q18_colocated"] = QUERIES["q18_mod_revenue_by_item"]
QUERIES["w05_restock_blocks"] = QUERIES["w05_restock"]
QUERIES["a05_empty_order_stats"] = _EMPTY_AVERAGE


def _needed(text: str) -> list[str]:
    """Point-of-sale tables that a text mentions, itself or through others, in order of use."""
    found: list[str] = []
    for name in dict.fromkeys(re.findall(r"\bpos_\w+", text)):
        for inner in [*_needed(TABLES[name]), name]:
            if inner not in found:
                found.append(inner)
    return found


def full_sql(body: str) -> str:
    """A query body with its tables as CTEs. A body may start with a comma and more CTEs."""
    body = body.strip()
    ctes = ", ".join(f"{name} as ({TABLES[name].strip()})" for name in _needed(body))
    if body.startswith(","):
        rest = body[1:].strip()
        return f"with {ctes}, {rest}" if ctes else f"with {rest}"
    return f"with {ctes} {body}" if ctes else body
