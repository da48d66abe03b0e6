"""The registered queries: each a text of the query language, or operators of the library, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora import function_queries
from arbora.engine import Engine
from arbora.operators import fulltext, nodes, sequences, updates, windows
from arbora.operators.paths import Paths
from arbora.sources import readers

Query = Callable[[SparkSession, str], DataFrame]

#: name: (query, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "flwor_group_aggregate": (
        """for $l in collection("lineitem") where $l?l_shipdate le xs:dateTime("1998-09-02T00:00:00")
           group by $f := $l?l_returnflag, $s := $l?l_linestatus
           return map { "f": $f, "s": $s, "n": count($l), "qty": sum($l?l_quantity), "price": round(sum($l?l_extendedprice * (1 - $l?l_discount))),
                        "low": min($l?l_quantity), "high": max($l?l_quantity), "mean": round(avg($l?l_quantity), 6) }""",
        """select l_returnflag f, l_linestatus s, count(*) n, sum(l_quantity) qty, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) price, min(l_quantity) low, max(l_quantity) high,
           floor(avg(l_quantity) * 1e6 + 0.5) / 1e6 mean from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
    ),
    "flwor_where": ("""for $l in collection("lineitem") where $l?l_quantity gt 45 and $l?l_discount lt 0.02 return map { "o": $l?l_orderkey, "n": $l?l_linenumber }""", "select l_orderkey o, l_linenumber n from lineitem where l_quantity > 45 and l_discount < 0.02"),
    "flwor_let": ("""for $l in collection("lineitem") let $p := $l?l_extendedprice * $l?l_quantity where $p gt 4000000 return map { "o": $l?l_orderkey, "n": $l?l_linenumber, "p": $p }""", "select l_orderkey o, l_linenumber n, l_extendedprice * l_quantity p from lineitem where l_extendedprice * l_quantity > 4000000"),
    "flwor_order_limit": ("""subsequence(for $o in collection("orders") order by $o?o_totalprice descending, $o?o_orderkey return map { "k": $o?o_orderkey, "p": $o?o_totalprice }, 1, 10)""", "select o_orderkey k, o_totalprice p from orders order by o_totalprice desc, o_orderkey limit 10"),
    "flwor_count": ("""for $c in collection("customer") order by $c?c_acctbal descending, $c?c_custkey count $n where $n le 5 return map { "n": $n, "k": $c?c_custkey }""", "select n, k from (select row_number() over (order by c_acctbal desc, c_custkey) n, c_custkey k from customer) where n <= 5"),
    "flwor_while": (
        """for $o in collection("orders") order by $o?o_orderkey while $o?o_totalprice gt 2000 return $o?o_orderkey""",
        "select o_orderkey item from (select o_orderkey, min((o_totalprice > 2000)::int) over (order by o_orderkey) ok from orders) where ok = 1",
    ),
    "flwor_at": ("""for $n in collection("nation") for $p at $i in tokenize($n?n_name, "_") return map { "k": $n?n_nationkey, "i": $i, "p": $p }""", "select n_nationkey k, unnest(range(1, len(string_split(n_name, '_')) + 1)) i, unnest(string_split(n_name, '_')) p from nation"),
    "flwor_allowing_empty": (
        """for $r in collection("region") for $n allowing empty in collection("nation")[?n_regionkey eq $r?r_regionkey and ?n_nationkey lt 3] return map { "r": $r?r_name, "n": $n?n_name }""",
        "select r_name r, n_name n from region left join nation on n_regionkey = r_regionkey and n_nationkey < 3",
    ),
    "flwor_otherwise": ("""for $o in collection("orders") where $o?o_totalprice lt 0 return $o?o_orderkey otherwise 7""", "select 7::bigint item"),
    "flwor_otherwise_some": ("""for $c in collection("customer") where $c?c_acctbal lt 0 return $c?c_custkey otherwise 7""", "select c_custkey item from customer where c_acctbal < 0"),
    "group_having": (
        """for $o in collection("orders") group by $c := $o?o_custkey let $n := count($o) where $n gt 15 return map { "c": $c, "n": $n, "p": round(sum($o?o_totalprice)) }""",
        "select o_custkey c, count(*) n, floor(sum(o_totalprice) + 0.5) p from orders group by 1 having count(*) > 15",
    ),
    "group_sequence": ("""for $n in collection("nation") group by $r := $n?n_regionkey return map { "r": $r, "names": string-join($n?n_name, "|"), "n": count(distinct-values($n?n_name)) }""", "select n_regionkey r, string_agg(n_name, '|' order by n_name) names, count(distinct n_name) n from nation group by 1"),
    "join_inner": (
        """for $c in collection("customer"), $o in collection("orders") where $o?o_custkey eq $c?c_custkey and $o?o_totalprice gt 400000 return map { "c": $c?c_name, "o": $o?o_orderkey }""",
        "select c_name c, o_orderkey o from customer join orders on o_custkey = c_custkey where o_totalprice > 400000",
    ),
    "join_star": (
        """for $n in collection("nation"), $r in collection("region"), $c in collection("customer") where $n?n_regionkey eq $r?r_regionkey and $c?c_nationkey eq $n?n_nationkey
           group by $name := $r?r_name return map { "r": $name, "n": count($c), "b": round(sum($c?c_acctbal)) }""",
        "select r_name r, count(*) n, floor(sum(c_acctbal) + 0.5) b from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1",
    ),
    "join_theta": ("""for $a in collection("region"), $b in collection("region") where $a?r_regionkey lt $b?r_regionkey return map { "a": $a?r_name, "b": $b?r_name }""", "select a.r_name a, b.r_name b from region a, region b where a.r_regionkey < b.r_regionkey"),
    "join_cross": ("""for $a in collection("region"), $b in collection("region") return map { "a": $a?r_regionkey, "b": $b?r_regionkey }""", "select a.r_regionkey a, b.r_regionkey b from region a, region b"),
    "join_semi": ("""for $c in collection("customer") where some $o in collection("orders") satisfies ($o?o_custkey eq $c?c_custkey and $o?o_totalprice gt 450000) return $c?c_custkey""", "select c_custkey item from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)"),
    "join_anti": ("""for $c in collection("customer") where not(exists(collection("orders")[?o_custkey eq $c?c_custkey and ?o_totalprice gt 100000])) return $c?c_custkey""", "select c_custkey item from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)"),
    "join_every": ("""for $n in collection("nation") where every $c in collection("customer") satisfies ($c?c_nationkey ne $n?n_nationkey or $c?c_acctbal gt -990) return $n?n_nationkey""", "select n_nationkey item from nation where not exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal <= -990)"),
    "join_general_eq": ("""for $c in collection("customer") where $c?c_custkey = collection("orders")[?o_totalprice gt 450000]?o_custkey return $c?c_custkey""", "select c_custkey item from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)"),
    "join_group": (
        """for $c in collection("customer") let $o := collection("orders")[?o_custkey eq $c?c_custkey] return map { "c": $c?c_custkey, "n": count($o), "p": round(sum($o?o_totalprice)) }""",
        "select c_custkey c, count(o_orderkey) n, floor(coalesce(sum(o_totalprice), 0) + 0.5) p from customer left join orders on o_custkey = c_custkey group by 1",
    ),
    "scalar_subquery": ("""let $m := avg(collection("part")?p_retailprice) for $p in collection("part") where $p?p_retailprice gt $m * 1.5 return $p?p_partkey""", "select p_partkey item from part where p_retailprice > (select avg(p_retailprice) from part) * 1.5"),
    "aggregate_count": ("""count(collection("orders")[?o_totalprice gt 1000])""", "select count(*) item from orders where o_totalprice > 1000"),
    "distinct_values": ("""distinct-values(collection("orders")?o_orderpriority)""", "select distinct o_orderpriority item from orders"),
    "union_values": ("""collection("customer")?c_nationkey union collection("supplier")?s_nationkey""", "select c_nationkey item from customer union select s_nationkey from supplier"),
    "intersect_values": ("""collection("customer")?c_nationkey intersect collection("supplier")?s_nationkey""", "select c_nationkey item from customer intersect select s_nationkey from supplier"),
    "except_values": ("""collection("nation")?n_nationkey except collection("supplier")[?s_acctbal gt 5000]?s_nationkey""", "select n_nationkey item from nation except select s_nationkey from supplier where s_acctbal > 5000"),
    "sequence_concat": ("""collection("region")?r_name, collection("region")?r_name""", "select r_name item from region union all select r_name from region"),
    "fn_highest": ("""highest(collection("part"), (), function($p) { $p?p_retailprice }) ! map { "k": ?p_partkey }""", "select p_partkey k from part where p_retailprice = (select max(p_retailprice) from part)"),
    "fn_filter_foreach": ("""for-each(filter(collection("part"), function($p) { $p?p_size eq 5 }), function($p) { $p?p_partkey * 2 })""", "select p_partkey * 2 item from part where p_size = 5"),
    "strings": (
        """for $p in collection("part") return map { "k": $p?p_partkey, "u": upper-case($p?p_name), "n": string-length($p?p_type), "s": substring($p?p_name, 2, 3), "b": substring-before($p?p_type, " "),
           "a": substring-after($p?p_type, " "), "c": contains($p?p_type, "STEEL"), "w": starts-with($p?p_name, "p"), "t": translate($p?p_brand, "#B", "-b"), "r": replace($p?p_brand, "[0-9]+", "<$0>"),
           "m": matches($p?p_brand, "^Brand#1"), "j": string-join(tokenize($p?p_type, " "), "_"), "x": $p?p_brand || "!" }""",
        """select p_partkey k, upper(p_name) u, length(p_type) n, substr(p_name, 2, 3) s, case when contains(p_type, ' ') then split_part(p_type, ' ', 1) else '' end b,
           case when contains(p_type, ' ') then substr(p_type, strpos(p_type, ' ') + 1) else '' end a, contains(p_type, 'STEEL') c, starts_with(p_name, 'p') w, translate(p_brand, '#B', '-b') t,
           regexp_replace(p_brand, '([0-9]+)', '<\\1>', 'g') r, regexp_matches(p_brand, '^Brand#1') m, replace(p_type, ' ', '_') j, p_brand || '!' x from part""",
    ),
    "numbers": (
        """for $p in collection("part") return map { "k": $p?p_partkey, "f": floor($p?p_retailprice), "c": ceiling($p?p_retailprice), "r": round($p?p_retailprice), "h": round-half-to-even($p?p_retailprice, 1),
           "i": $p?p_size idiv 7, "m": $p?p_size mod 7, "d": round($p?p_retailprice div 3, 4), "n": -$p?p_size, "a": abs($p?p_size - 25), "x": number(substring-after($p?p_brand, "#")), "s": round(math:sqrt($p?p_size), 6) }""",
        """select p_partkey k, floor(p_retailprice) f, ceil(p_retailprice) c, floor(p_retailprice + 0.5) r, round_even(p_retailprice, 1) h, (p_size // 7)::bigint i, (p_size % 7)::bigint m, floor(p_retailprice / 3 * 1e4 + 0.5) / 1e4 d, -p_size n,
           abs(p_size - 25)::bigint a, case when contains(p_brand, '#') then coalesce(try_cast(split_part(p_brand, '#', 2) as double), 'nan'::double) else 'nan'::double end x, floor(sqrt(p_size) * 1e6 + 0.5) / 1e6 s from part""",
    ),
    "math": (
        """for $p in collection("part") return map { "k": $p?p_partkey, "e": round(math:exp($p?p_size div 10e0), 6), "l": round(math:log($p?p_size), 6), "p": math:pow($p?p_size, 2), "c": round(math:cos($p?p_size), 6), "t": round(math:atan2($p?p_size, 2), 6) }""",
        """select p_partkey k, floor(exp(p_size / 10.0::double) * 1e6 + 0.5) / 1e6 e, floor(ln(p_size) * 1e6 + 0.5) / 1e6 l, pow(p_size, 2) p, floor(cos(p_size) * 1e6 + 0.5) / 1e6 c, floor(atan2(p_size, 2) * 1e6 + 0.5) / 1e6 t from part""",
    ),
    "dates": (
        """for $o in collection("orders") return map { "k": $o?o_orderkey, "y": year-from-dateTime($o?o_orderdate), "m": month-from-dateTime($o?o_orderdate), "d": day-from-dateTime($o?o_orderdate),
           "h": hours-from-dateTime($o?o_orderdate), "f": format-dateTime($o?o_orderdate, "[D01]/[M01]/[Y0001]"), "n": string(xs:date($o?o_orderdate) + xs:dayTimeDuration("P30D")) }""",
        """select o_orderkey k, year(o_orderdate) y, month(o_orderdate) m, day(o_orderdate) d, hour(o_orderdate) h, strftime(o_orderdate, '%d/%m/%Y') f, (o_orderdate::date + 30)::varchar n from orders""",
    ),
    "casts": (
        """for $p in collection("part") return map { "k": $p?p_partkey, "i": xs:integer(substring-after($p?p_brand, "#")), "s": string($p?p_size), "b": xs:boolean($p?p_size mod 2), "ok": $p?p_name castable as xs:integer, "d": xs:double($p?p_size), "t": try { xs:integer($p?p_name) } catch * { -1 } }""",
        """select p_partkey k, split_part(p_brand, '#', 2)::bigint i, p_size::varchar s, (p_size % 2)::boolean b, try_cast(p_name as bigint) is not null ok, p_size::double d, (-1)::bigint t from part""",
    ),
    "conditionals": (
        """for $p in collection("part") return map { "k": $p?p_partkey, "i": if ($p?p_size gt 25) then "big" else "small", "s": switch ($p?p_size mod 4) case 0 return "zero" case 1 case 2 return "low" default return "high" }""",
        """select p_partkey k, case when p_size > 25 then 'big' else 'small' end i, case p_size % 4 when 0 then 'zero' when 1 then 'low' when 2 then 'low' else 'high' end s from part""",
    ),
    "sequences": (
        """for $p in collection("part") let $s := 1 to $p?p_size return map { "k": $p?p_partkey, "n": count($s), "t": sum($s), "e": count($s[. mod 2 eq 0]), "h": head($s), "l": foot($s), "r": string-join(reverse($s) ! string(.), ","),
           "x": string-join(subsequence($s, 2, 3) ! string(.), ","), "i": string-join(index-of($s, 3) ! string(.), ","), "f": fold-left($s, 0, function($a, $b) { $a + $b * $b }), "q": some $z in $s satisfies $z eq 7, "d": string-join(scan-left($s, 0, function($a, $b) { $a + $b }) ! string(.), ",") }""",
        """select p_partkey k, p_size::bigint n, (p_size * (p_size + 1) // 2)::bigint t, (p_size // 2)::bigint e, 1::bigint h, p_size::bigint l, array_to_string(list_reverse(range(1, p_size + 1)), ',') r, array_to_string(range(2, least(5, p_size + 1)), ',') x, case when p_size >= 3 then '3' else '' end i,
           (p_size * (p_size + 1) * (2 * p_size + 1) // 6)::bigint f, p_size >= 7 q, array_to_string(list_transform(range(0, p_size + 1), lambda z: z * (z + 1) // 2), ',') d from part""",
    ),
    "arrays_maps": (
        """for $p in collection("part") let $a := [$p?p_size, 3, 1], $m := map:merge((map:entry("a", $p?p_size), map:entry("b", 2), map:entry("a", 9)))
           return map { "k": $p?p_partkey, "n": array:size($a), "g": $a(2), "s": string-join(array:sort($a)?* ! string(.), ","), "v": $m("a"), "c": map:contains($m, "b"), "z": map:size($m), "h": array:head(array:reverse($a)), "t": array:fold-left($a, 0, function($x, $y) { $x + $y }) }""",
        """select p_partkey k, 3::bigint n, 3::bigint g, array_to_string(list_sort([p_size, 3, 1]), ',') s, p_size::bigint v, true c, 2::bigint z, 1::bigint h, (p_size + 4)::bigint t from part""",
    ),
    "json_lookup": ("""for $e in collection("events") group by $k := $e?props?k return map { "k": $k, "n": count($e) }""", "select json_extract_string(props, '$.k') k, count(*) n from events group by 1"),
    "window_tumbling": (
        """for $n in (3, 5, 8) for tumbling window $w in (1 to $n) start at $s when true() end at $e when $e - $s eq 2 return map { "n": $n, "s": $s, "w": string-join($w ! string(.), ",") }""",
        """select n::bigint n, s + 1 s, array_to_string(range(s + 1, least(s + 4, n + 1)), ',') w from (values (3), (5), (8)) v(n), lateral (select unnest(range(0, n, 3)) s)""",
    ),
    "window_sliding": (
        """for sliding window $w in (1 to 6) start at $s when true() only end at $e when $e - $s eq 1 return map { "s": $s, "w": sum($w) }""",
        "select s, s + s + 1 w from (select unnest(range(1, 6)) s)",
    ),
    "functions_user": ("""declare function local:net($p, $d) { $p * (1 - $d) }; for $l in collection("lineitem") return map { "o": $l?l_orderkey, "n": $l?l_linenumber, "x": round(local:net($l?l_extendedprice, $l?l_discount), 2) }""", "select l_orderkey o, l_linenumber n, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 x from lineitem"),
    "partial_application": ("""let $f := concat(?, "-", ?) for $r in collection("region") return $f($r?r_name, string($r?r_regionkey))""", "select r_name || '-' || r_regionkey item from region"),
    "fulltext_words": ("""for $d in collection("documents") where $d?text contains text "license" ftand ftnot "apache" return $d?doc_id""", "select doc_id item from documents where list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'license') and not list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'apache')"),
    "fulltext_diacritics": ("""for $d in collection("documents") where $d?text contains text "uber" using diacritics insensitive return $d?doc_id""", "select doc_id item from documents where list_contains(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), 'uber')"),
    "fulltext_phrase": ("""for $d in collection("documents") where $d?text contains text "all rights reserved" phrase return $d?doc_id""", "select doc_id item from documents where contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' all rights reserved ')"),
}

_TAGS = "(select page_id, regexp_extract_all(html, '<li[ >]') li, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) href from pages)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    Engine(spark)
    return readers.documents(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "html")


def path_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Paths(_nodes(spark, sf_dir)).select("//li").groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


def path_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Paths(_nodes(spark, sf_dir)).select("//nav//a/@href").select(F.col("doc_id").alias("page_id"), F.col("string_value").alias("href"))


def path_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Paths(_nodes(spark, sf_dir)).select("//ul/li[2]/a").select(F.col("doc_id").alias("page_id"), F.col("string_value").alias("text"))


def path_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Paths(_nodes(spark, sf_dir)).select("//div[@class = 'ad']").groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


def path_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings behind nav that are articles, reached through ancestors of its links."""
    return Paths(_nodes(spark, sf_dir)).select("//a/ancestor::nav/following-sibling::article").select(F.col("doc_id").alias("page_id"), F.col("local").alias("name"))


#: A path by each axis, and the start tag that its nodes have in the markup.
AXES = {
    "child": ("//ul/child::li", "<li>"), "self": ("//li/self::li", "<li>"), "parent": ("//a/parent::li", "<li>"), "ancestor": ("//a/ancestor::ul", "<ul>"), "ancestor-or-self": ("//li/ancestor-or-self::nav", "<nav>"),
    "descendant": ("//nav/descendant::a", "<a "), "descendant-or-self": ("//ul/descendant-or-self::li", "<li>"), "following-sibling": ("//nav/following-sibling::footer", "<footer>"),
    "preceding-sibling": ("//article/preceding-sibling::nav", "<nav>"), "following": ("//ul/following::h1", "<h1>"), "preceding": ("//footer/preceding::li", "<li>"), "attribute": ("//a/attribute::href", " href="),
}


def path_every_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per page that a path by each axis finds."""
    p = Paths(sequences.durable(_nodes(spark, sf_dir)))
    parts = [p.select(path).groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n")).select("page_id", F.lit(axis).alias("axis"), "n") for axis, (path, _) in AXES.items()]
    return reduce(DataFrame.unionByName, parts)


def node_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Paths(_nodes(spark, sf_dir))
    every = nodes.except_(nodes.union(p.select("//nav"), p.select("//nav//li")), p.select("//li"))
    return every.select(F.col("doc_id").alias("page_id"), F.col("local").alias("name"))


def update_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames every li to item, gives each nav an empty mark in front, and deletes the adverts."""
    n = sequences.durable(_nodes(spark, sf_dir))
    p = Paths(n)
    edits = updates.edit("rename", p.select("//li"), name="item").union(updates.edit("insert-first", p.select("//nav"), content="<mark/>")).union(updates.edit("delete", p.select("//div[@class = 'ad']")))
    after = updates.apply(n, edits)
    return after.where("kind = 'element' and local in ('li', 'item', 'mark', 'div')").groupBy(F.col("doc_id").alias("page_id"), F.col("local").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that customer 0 reaches when k leads to 2 k + 1 and 3 k + 1."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    edges = c.select(F.col("c_custkey").alias("src"), F.explode(F.array(F.col("c_custkey") * 2 + 1, F.col("c_custkey") * 3 + 1)).alias("dst")).join(c.withColumnRenamed("c_custkey", "dst"), "dst", "left_semi").select("src", "dst")
    return sequences.transitive_closure(c.where("c_custkey = 0").withColumnRenamed("c_custkey", "item"), edges)


def window_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows per user: a new one whenever the event's type changes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = windows.islands(e, ["user_id"], ["ts", "event_id"], lambda before: before("event_type") != F.col("event_type"))
    return w.groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("event_type"))


def node_sets_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations in a query text go by the nodes' identity: links with equal texts stay apart."""
    e = Engine(spark, sf_dir).register_documents("pages", spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "html")
    return e.query("""((doc("pages")//li union doc("pages")//nav union doc("pages")//nav//li) except doc("pages")//nav) ! map { "name": name(.), "text": string(.) }""")


def transform_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates in a query text: copies of the pages with other names, a mark in each nav, and no adverts."""
    e = Engine(spark, sf_dir).register_documents("pages", spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "html")
    return e.query("""copy $c := doc("pages") modify (rename nodes $c//li as "item", insert node <mark k="1">new</mark> as first into $c//nav, delete nodes $c//div[@class = 'ad'])
                      return ($c//item union $c//mark union $c//li union $c//div[@class = 'ad']) ! map { "name": name(.), "text": string(.) }""")


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from an inverted index with positions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fulltext.bm25(fulltext.postings(docs, "doc_id", "text"), ["license", "version"]).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fulltext.bm25_of(docs, "doc_id", "text", ["license", "version"]).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


_BM25 = """with t as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)*') w from documents), l as (select doc_id, len(w) n from t where len(w) > 0),
        h as (select doc_id, term, len(list_filter(w, lambda x: x = term)) tf from t, (values ('license'), ('version')) v(term) where list_contains(w, term)), d as (select term, count(*) df from h group by 1), a as (select count(*) n, avg(n) mean from l)
        select h.doc_id, round(sum(ln((a.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / mean))), 6) score from h join d using (term) join l using (doc_id), a group by 1"""

OPERATORS: dict[str, tuple[Query, str]] = {
    "path_descendant": (path_descendant, f"select page_id, len(li) n from {_TAGS} where len(li) > 0"),
    "path_attribute": (path_attribute, f"select page_id, unnest(href) href from {_TAGS}"),
    "path_positional": (path_positional, "select page_id, replace(regexp_extract(html, '<ul><li>.*?</li><li><a href=\"[^\"]*\">(.*?)</a>', 1), '&amp;', '&') as text from pages"),
    "path_predicate": (path_predicate, "select page_id, len(regexp_extract_all(html, '<div class=\"ad\">')) n from pages"),
    "path_axes": (path_axes, "select page_id, 'article' as name from pages"),
    "path_every_axis": (path_every_axis, "select * from (" + " union all ".join(f"select page_id, '{axis}' as axis, len(regexp_extract_all(html, '{tag}')) n from pages" for axis, (_, tag) in AXES.items()) + ") where n > 0"),
    "node_sets": (node_sets, "select page_id, 'nav' as name from pages"),
    "update_nodes": (update_nodes, f"select page_id, 'item' as name, len(li) n from {_TAGS} union all select page_id, 'mark', 1 from pages"),
    "transitive_closure": (transitive_closure, "with recursive r(item) as (select 0::bigint union select c_custkey from customer join r on c_custkey = item * 2 + 1 or c_custkey = item * 3 + 1) select item from r"),
    "window_islands": (window_islands, """select user_id, window_id::bigint window_id, count(*) n, min(event_type) event_type from (select *, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) window_id from
        (select *, case when lag(event_type) over w = event_type then 0 else 1 end f from events window w as (partition by user_id order by ts, event_id))) group by 1, 2"""),
    "node_sets_text": (node_sets_text, "select 'li' as name, trim(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&amp;', '&')) as text from (select unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) t from pages)"),
    "transform_copy": (transform_copy, "select 'item' as name, trim(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&amp;', '&')) as text from (select unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) t from pages) union all select 'mark', 'new' from pages"),
    "bm25": (bm25, _BM25),
    "bm25_index": (bm25_index, _BM25),
}


def _run(text: str) -> Query:
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(text)


def queries() -> dict[str, Query]:
    return {k: _run(q) for k, (q, _) in (TEXTS | function_queries.TEXTS).items()} | {k: f for k, (f, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in (TEXTS | function_queries.TEXTS).items()} | {k: s for k, (_, s) in OPERATORS.items()}
