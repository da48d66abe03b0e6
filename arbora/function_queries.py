"""Registered queries of the function library, family by family, each over a whole table and with the same in SQL."""

from __future__ import annotations

_M = "with t as (select p_partkey k, p_name, p_brand, p_type, p_size::bigint z, [p_size, 3, p_size % 5, 3]::bigint[] m, range(1, p_size + 1) s, p_retailprice r from part)"


def _list(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _words(x: str) -> str:
    return f'string-join({x} ! string(.), ",")'


def _map(fields: dict[str, str]) -> str:
    return "map { " + ", ".join(f'"{k}": {v}' for k, v in fields.items()) + " }"


def _pair(start: str, fields: dict[str, tuple[str, str]], source: str) -> tuple[str, str]:
    """A query over rows and its SQL from (expression, SQL expression) by column."""
    return f"{start} return {_map({k: v[0] for k, v in fields.items()})}", f"{source.partition('|')[0]} select {', '.join(f'{v[1]} as {k}' for k, v in fields.items())} from {source.partition('|')[2]}"


_PART = 'for $p in collection("part") let $z := $p?p_size, $m := ($p?p_size, 3, $p?p_size mod 5, 3), $s := 1 to $p?p_size'
_FROM = f"{_M}|t"
_KEY = ("$p?p_partkey", "k")

#: Sorting by a key compares keys as strings.
_BY = _list("list_transform(list_sort(list_transform(m, lambda x: (100 - x)::varchar)), lambda y: 100 - y::bigint)")

TEXTS: dict[str, tuple[str, str]] = {
    "fn_strings": _pair(
        'for $p in collection("part")',
        {
            "k": _KEY,
            "ends": ('ends-with($p?p_name, "ring")', "ends_with(p_name, 'ring')"),
            "low": ("lower-case($p?p_type)", "lower(p_type)"),
            "norm": ('normalize-space(concat("  ", $p?p_name, "   x "))', "p_name || ' x'"),
            "cmp": ('compare($p?p_name, "hot gear")', "case when p_name < 'hot gear' then -1 when p_name = 'hot gear' then 0 else 1 end::bigint"),
            "points": (_words("string-to-codepoints(substring($p?p_name, 1, 3))"), _list("list_transform(string_split(substr(p_name, 1, 3), ''), lambda x: ord(x))")),
            "turned": ("codepoints-to-string(reverse(string-to-codepoints($p?p_name)))", "reverse(p_name)"),
            "same": ('codepoint-equal($p?p_type, "SMALL")', "p_type = 'SMALL'"),
            "uri": ("encode-for-uri($p?p_brand)", "replace(p_brand, '#', '%23')"),
            "html": ('escape-html-uri(concat($p?p_name, "é"))', "p_name || '%C3%A9'"),
            "iri": ('iri-to-uri(concat($p?p_name, "é"))', "replace(p_name, ' ', '%20') || '%C3%A9'"),
            "token": ('contains-token($p?p_name, "ring")', "list_contains(string_split(p_name, ' '), 'ring')"),
            "first": ("codepoint(substring($p?p_name, 1, 1))", "ord(p_name)::bigint"),
            "chars": ('string-join(characters($p?p_name), ".")', "array_to_string(string_split(p_name, ''), '.')"),
            "letter": ('char("41") || $p?p_name', "'A' || p_name"),
            "nfd": ('string-length(normalize-unicode(concat($p?p_name, "é"), "NFD"))', "length(p_name)::bigint + 2"),
            "lang": ("default-language() || $p?p_name", "'en' || p_name"),
            "coll": ("contains(default-collation(), $p?p_name)", "false"),
            "graph": ("count(graphemes($p?p_name))", "length(p_name)::bigint"),
            "esc": ('replace($p?p_name, "(\\w+) (\\w+)", "$2-$1")', "regexp_replace(p_name, '(\\w+) (\\w+)', '\\2-\\1')"),
            "data": ("data($p?p_name)", "p_name"),
        },
        _FROM,
    ),
    "fn_sequences": _pair(
        _PART,
        {
            "k": _KEY,
            "tail": (_words("tail($m)"), _list("m[2:]")),
            "trunk": (_words("trunk($m)"), _list("m[:3]")),
            "ins": (_words("insert-before($m, 2, 99)"), _list("[m[1], 99, m[2], m[3], m[4]]")),
            "rem": (_words("remove($m, 2)"), _list("[m[1], m[3], m[4]]")),
            "dist": (_words("distinct-values($m)"), _list("list_filter(m, lambda x, i: list_position(m, x) = i)")),
            "zero": ("zero-or-one($z)", "z"),
            "more": ("count(one-or-more($s))", "z"),
            "exact": ("exactly-one($z)", "z"),
            "unord": ("sum(unordered($m))", "list_sum(m)::bigint"),
            "same": ("identity($z)", "z::int"),
            "rep": (_words("replicate($z, 2)"), _list("[z, z]")),
            "none": ("empty(void($m))", "true"),
            "some": ("exists($s) and boolean($z)", "true"),
            "no": ("false() or empty($m)", "false"),
            "at": (_words("items-at($m, (1, 4))"), _list("[m[1], m[4]]")),
            "slice": (_words("slice($s, 2, 8, 3)"), _list("list_filter([2, 5, 8], lambda x: x <= z)")),
            "alleq": ("all-equal(($z, 7))", "z = 7"),
            "alldiff": ("all-different(($z, 7))", "z <> 7"),
            "whr": (_words("index-where($m, function($x) { $x gt 3 })"), _list("list_filter([1, 2, 3, 4], lambda i: m[i] > 3)")),
            "scan": (_words("scan-right($m, 0, function($a, $b) { $a + $b })"), _list("[m[1] + m[2] + m[3] + m[4], m[2] + m[3] + m[4], m[3] + m[4], m[4], 0]")),
            "dup": (_words("duplicate-values($m)"), _list("list_filter(m, lambda x, i: len(list_filter(m[:i], lambda y: y = x)) = 2)")),
            "ateq": ("atomic-equal($z, 7)", "z = 7"),
            "sub": ("contains-subsequence($s, (3, 4))", "z >= 4"),
            "starts": ("starts-with-subsequence($s, (1, 2))", "z >= 2"),
            "ends": ("ends-with-subsequence($s, ($z - 1, $z))", "z >= 2"),
            "sep": (_words("insert-separator($m, 0)"), _list("[m[1], 0, m[2], 0, m[3], 0, m[4]]")),
            "inter": (_words("intersperse($m, 0)"), _list("[m[1], 0, m[2], 0, m[3], 0, m[4]]")),
            "low": (_words("lowest($m)"), _list("list_filter(m, lambda x: x = list_min(m))")),
            "swith": (_words("sort-with($m, function($a, $b) { $b - $a })"), _list("list_reverse_sort(m)")),
            "sort": (_words("sort($m)"), _list("list_sort(m)")),
            "anyy": ("some($m, function($x) { $x gt 40 })", "z > 40"),
            "alll": ("every($m, function($x) { $x lt 40 })", "z < 40"),
            "foldr": ('fold-right($m, "", function($a, $b) { concat($a, "/", $b) })', "array_to_string(m, '/') || '/'"),
            "pairs": (_words("for-each-pair($m, $s, function($a, $b) { $a * $b })"), _list("list_filter([m[1], m[2] * 2, m[3] * 3, m[4] * 4], lambda x, i: i <= z)")),
            "app": ("apply(function($a, $b) { $a + $b }, [$z, 2])", "z + 2"),
            "nan": ("is-NaN(number($p?p_name))", "true"),
            "pin": ("pin($z)", "z::int"),
            "dor": (_words("distinct-ordered($m)"), _list("list_filter(m, lambda x, i: list_position(m, x) = i)")),
            "uni": ("uniform(($z, $z))", "true"),
            "deep": ("deep-equal($m, ($z, 3, 1, 3))", "z % 5 = 1"),
            "idx": ("count(index-of($m, 3))", "len(list_filter(m, lambda x: x = 3))::bigint"),
            "trc": ("trace($z)", "z::int"),
            "iter": ("iterate-while($z, function($x) { $x idiv 2 }, function($x) { $x gt 3 })", "case when z <= 3 then z when z // 2 <= 3 then z // 2 when z // 4 <= 3 then z // 4 when z // 8 <= 3 then z // 8 else z // 16 end"),
            "sorted": (_words("sort-by($m, function($x) { 100 - $x })"), _BY),
        },
        _FROM,
    ),
    "fn_dates": _pair(
        'for $e in collection("events") let $d := xs:date($e?ts), $m := xs:yearMonthDuration(concat("P", string($e?user_id), "M")), $u := $e?ts - xs:dateTime("2024-01-01T00:00:00")',
        {
            "k": ("$e?event_id", "event_id"),
            "y": ("year-from-date($d)", "year(ts)"),
            "m": ("month-from-date($d)", "month(ts)"),
            "d": ("day-from-date($d)", "day(ts)"),
            "mi": ("minutes-from-dateTime($e?ts)", "minute(ts)"),
            "s": ("xs:integer(floor(seconds-from-dateTime($e?ts)))", "second(ts)"),
            "yy": ("years-from-duration($m)", "user_id // 12"),
            "mm": ("months-from-duration($m)", "user_id % 12"),
            "dd": ("days-from-duration($u)", "date_diff('second', timestamp '2024-01-01', date_trunc('second', ts)) // 86400"),
            "hh": ("hours-from-duration($u)", "hour(ts)"),
            "ii": ("minutes-from-duration($u)", "minute(ts)"),
            "ss": ("xs:integer(floor(seconds-from-duration($u)))", "second(ts)"),
            "dt": ('string(dateTime($d, "10:20:30"))', "strftime(ts, '%Y-%m-%dT10:20:30')"),
            "later": ("string($d + $m)", "(ts::date + to_months(user_id::int))::date::varchar"),
            "f": ('format-date($d, "[D01].[M01].[Y0001]")', "strftime(ts, '%d.%m.%Y')"),
            "now": ("current-date() gt $d and current-dateTime() gt $e?ts", "true"),
            "zone": ('string(xs:dateTime(concat(substring(string($e?ts), 1, 19), "+05:30")))', "strftime(date_trunc('second', ts) - interval 330 minute, '%Y-%m-%dT%H:%M:%S')"),
            "mail": ('string(parse-ietf-date(concat("Wed, 06 Jun 2001 07:29:", substring(string($e?ts), 18, 2), " -0500")))', "'2001-06-06T12:29:' || strftime(ts, '%S')"),
            "lt": ('$e?ts lt xs:dateTime("2024-01-08T00:00:00")', "ts < timestamp '2024-01-08'"),
        },
        "|events",
    ),
    "fn_math": _pair(
        _PART,
        {
            "k": _KEY,
            "pi": ("round(math:pi() * $z, 6)", "floor(pi() * z * 1e6 + 0.5) / 1e6"),
            "e": ("round(math:e() * $z, 6)", "floor(exp(1) * z * 1e6 + 0.5) / 1e6"),
            "ten": ("round(math:exp10($z div 50e0), 6)", "floor(pow(10, z / 50.0::double) * 1e6 + 0.5) / 1e6"),
            "lg": ("round(math:log10($z), 6)", "floor(log10(z) * 1e6 + 0.5) / 1e6"),
            "si": ("round(math:sin($z), 6)", "floor(sin(z) * 1e6 + 0.5) / 1e6"),
            "ta": ("round(math:tan($z), 6)", "floor(tan(z) * 1e6 + 0.5) / 1e6"),
            "asi": ("round(math:asin($z div 50e0), 6)", "floor(asin(z / 50.0::double) * 1e6 + 0.5) / 1e6"),
            "aco": ("round(math:acos($z div 50e0), 6)", "floor(acos(z / 50.0::double) * 1e6 + 0.5) / 1e6"),
            "ata": ("round(math:atan($z), 6)", "floor(atan(z) * 1e6 + 0.5) / 1e6"),
            "mx": ("max($m)", "list_max(m)"),
            "mn": ("min($m)", "list_min(m)"),
            "av": ("round(xs:double(avg($m)), 4)", "floor(list_avg(m) * 1e4 + 0.5) / 1e4"),
            "dd": ("round(xs:double(divide-decimals(xs:decimal($z), xs:decimal(4), 2)), 2)", "z / 4.0::double"),
        },
        _FROM,
    ),
    "fn_maps": _pair(
        _PART + ', $a := map:merge((map:entry("a", $z), map:entry("b", 2), map:entry("c", $z mod 3)))',
        {
            "k": _KEY,
            "keys": ('string-join(sort(map:keys($a)), ",")', "'a,b,c'"),
            "get": ('map:get($a, "c")', "z % 3"),
            "put": ('map:get(map:put($a, "d", $z + 1), "d")', "z + 1"),
            "rem": ('map:size(map:remove($a, "b"))', "2::bigint"),
            "each": ('string-join(sort(map:for-each($a, function($x, $y) { concat($x, "=", $y) })), ";")', "'a=' || z || ';b=2;c=' || z % 3"),
            "fil": ("map:size(map:filter($a, function($x, $y) { $y gt 2 }))", "(z > 2)::int::bigint"),
            "whr": ('string-join(sort(map:keys-where($a, function($y) { $y eq 2 })), ",")', "concat_ws(',', case when z = 2 then 'a' end, 'b', case when z % 3 = 2 then 'c' end)"),
            "rep": ('map:get(map:replace($a, "a", 0), "a")', "0::bigint"),
            "cnt": ("count(map:entries($a))", "3::bigint"),
            "pair": ('map:get(map:of-pairs((map:pair("x", $z), map:pair("y", 1))), "x")', "z"),
            "grp": ("map:size(map:group-by($m, function($x) { string($x mod 2) }))", "len(list_distinct(list_transform(m, lambda x: x % 2)))::bigint"),
            "bld": ("map:size(map:build($m, function($x) { string($x) }, function($x) { $x * 2 }))", "len(list_distinct(m))::bigint"),
            "find": ('count(map:find($a, "b"))', "1::bigint"),
            "emp": ("map:size(map:empty())", "0::bigint"),
            "look": ("$a?a + $a?b", "z + 2"),
            "itm": ("count(map:items($a))", "3::bigint"),
        },
        _FROM,
    ),
    "fn_arrays": _pair(
        _PART + ", $a := [$z, 3, $z mod 5, 3]",
        {
            "k": _KEY,
            "get": ("array:get($a, 3)", "m[3]"),
            "put": (_words("array:put($a, 2, 9)?*"), _list("[m[1], 9, m[3], m[4]]")),
            "app": (_words("array:append($a, 8)?*"), _list("list_append(m, 8)")),
            "sub": (_words("array:subarray($a, 2, 2)?*"), _list("m[2:3]")),
            "rem": (_words("array:remove($a, (1, 3))?*"), _list("[m[2], m[4]]")),
            "ins": (_words("array:insert-before($a, 2, 7)?*"), _list("[m[1], 7, m[2], m[3], m[4]]")),
            "tail": (_words("array:tail($a)?*"), _list("m[2:]")),
            "join": (_words("array:join(($a, [1, 2]))?*"), _list("list_concat(m, [1, 2])")),
            "each": (_words("array:for-each($a, function($x) { $x * 2 })?*"), _list("list_transform(m, lambda x: x * 2)")),
            "fil": (_words("array:filter($a, function($x) { $x gt 2 })?*"), _list("list_filter(m, lambda x: x > 2)")),
            "foldr": ('array:fold-right($a, "", function($x, $y) { concat($x, "/", $y) })', "array_to_string(m, '/') || '/'"),
            "pairs": (_words("array:for-each-pair($a, [1, 2, 3, 4], function($x, $y) { $x + $y })?*"), _list("[m[1] + 1, m[2] + 2, m[3] + 3, m[4] + 4]")),
            "flat": (_words("array:flatten($a)"), _list("m")),
            "items": ("sum(array:items($a))", "list_sum(m)::bigint"),
            "sby": (_words("array:sort-by($a, function($x) { 100 - $x })?*"), _BY),
            "members": ("count(array:members($a))", "4::bigint"),
            "ofm": ("array:size(array:of-members(array:members($a)))", "4::bigint"),
            "emp": ("array:size(array:empty())", "0::bigint"),
            "bld": (_words("array:build($m, function($x) { $x + 1 })?*"), _list("list_transform(m, lambda x: x + 1)")),
            "foot": ("array:foot($a)", "m[4]"),
            "trunk": (_words("array:trunk($a)?*"), _list("m[:3]")),
            "idx": (_words("array:index-of($a, 3)"), _list("list_filter([1, 2, 3, 4], lambda i: m[i] = 3)")),
            "whr": (_words("array:index-where($a, function($x) { $x gt 2 })"), _list("list_filter([1, 2, 3, 4], lambda i: m[i] > 2)")),
            "slice": (_words("array:slice($a, 2, 3)?*"), _list("m[2:3]")),
            "swith": (_words("array:sort-with($a, function($x, $y) { $x - $y })?*"), _list("list_sort(m)")),
            "split": ("array:size(array:split($a, 2))", "2::bigint"),
            "mem": ("sum(for member $x in $a return $x)", "list_sum(m)::bigint"),
            "look": ("$a(1) + $a?2", "z + 3"),
        },
        _FROM,
    ),
    "fn_casts": _pair(
        _PART + ", $t := string($z)",
        {
            "k": _KEY,
            **{x.replace("-", "_").lower(): (f"xs:{x}($t) + 0", "z") for x in ("long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")},
            **{x.lower(): (f'xs:{x}(concat("-", $t)) + 0', "-z") for x in ("nonPositiveInteger", "negativeInteger")},
            **{x.lower(): (f'concat(xs:{x}(concat("a", $t)), "")', "'a' || z") for x in ("string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN", "ID", "IDREF", "ENTITY", "anyURI", "untypedAtomic")},
            "dec": ("xs:double(xs:decimal($t) * 2)", "z * 2.0::double"),
            "flo": ("xs:double(xs:float($t))", "z::double"),
            "bin": ('string(xs:hexBinary("0" || string($z mod 10)))', "'0' || z % 10"),
            "ymd": ('string(xs:yearMonthDuration(concat("P", $t, "M")))', "'P' || case when z >= 12 then (z // 12) || 'Y' else '' end || case when z % 12 > 0 then (z % 12) || 'M' else '' end"),
            "gyear": ('concat(xs:gYear(concat("20", substring(concat("0", $t), string-length($t)))), "")', "'20' || lpad(z::varchar, 2, '0')"),
            "castable": ("$p?p_name castable as xs:double or $t castable as xs:byte", "true"),
            "inst": ("$z instance of xs:integer", "true"),
            "treat": ("($z treat as xs:integer) + 1", "z + 1"),
            "time": ('xs:time(concat("10:20:", substring(concat("0", string($z mod 60)), string-length(string($z mod 60)))))', "'10:20:' || lpad((z % 60)::varchar, 2, '0')"),
            "many": (_words('xs:NMTOKENS(concat($t, " b"))'), "z || ',b'"),
            "numeric": ("xs:numeric($z) + 1", "z + 1"),
            "days": ('string(xs:dayTimeDuration(concat("PT", $t, "H")))', "case when z % 24 = 0 then 'P' || z // 24 || 'D' else 'P' || case when z >= 24 then (z // 24) || 'D' else '' end || 'T' || z % 24 || 'H' end"),
            "tried": ('try { xs:integer($p?p_name) } catch * { $z }', "z"),
            "divided": ("try { 10 idiv ($z mod 3) } catch * { -1 }", "case when z % 3 = 0 then -1 else 10 // (z % 3) end::bigint"),
        },
        _FROM,
    ),
    "fn_formats": _pair(
        _PART,
        {
            "k": _KEY,
            "roman": ('format-integer($z, "I")', "(['', 'X', 'XX', 'XXX', 'XL', 'L'])[z // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[z % 10 + 1]"),
            "letter": ('format-integer($z mod 26 + 1, "a")', "chr((97 + z % 26)::int)"),
            "padded": ('format-integer($z, "0001")', "lpad(z::varchar, 4, '0')"),
            "money": ('format-number($p?p_retailprice, "#,##0.00")', "format('{:,.2f}', r)"),
            "plain": ('format-number($z, "000")', "lpad(z::varchar, 3, '0')"),
            "json": ("serialize($z)", "z::varchar"),
            "uri": ('resolve-uri("x", "http://h.example/a/b") || $p?p_brand', "'http://h.example/a/x' || p_brand"),
            "q": ('local-name-from-QName(QName("http://u", concat("p:n", string($z))))', "'n' || z"),
            "pre": ('prefix-from-QName(QName("http://u", concat("p:n", string($z))))', "'p'"),
            "ns": ('concat(namespace-uri-from-QName(QName("http://u", concat("p:n", string($z)))), "")', "'http://u'"),
        },
        _FROM,
    ),
    "fn_functions": _pair(
        _PART + ", $f := upper-case#1, $g := function($x, $y) { $x * $y }, $h := $g(?, 3)",
        {
            "k": _KEY,
            "ref": ("$f($p?p_name)", "upper(p_name)"),
            "part": ("$h($z)", "z * 3"),
            "arity": ("function-arity($g)", "2::int"),
            "arrow": ('$p?p_name => upper-case() => concat("!")', "upper(p_name) || '!'"),
            "look": ('function-lookup(xs:QName("fn:string-length"), 1)($p?p_name)', "length(p_name)::bigint"),
            "each": (_words("for-each($m, $h)"), _list("list_transform(m, lambda x: x * 3)")),
            "pick": (_words("filter($m, function($x) { $x eq 3 })"), _list("list_filter(m, lambda x: x = 3)")),
            "other": ("head(() otherwise $z)", "z"),
            "range": ("sum(2 to $z)", "case when z < 2 then 0 else (z * (z + 1) // 2) - 1 end"),
            "cond": ("if ($z gt 25 and not($z eq 30)) then 1 else 0", "(z > 25 and z <> 30)::int::bigint"),
        },
        _FROM,
    ),
    "construct_element": (
        """for $c in collection("customer") return <customer id="{$c?c_custkey}" seg="s-{lower-case($c?c_mktsegment)}"><name>{$c?c_name}</name>{if ($c?c_acctbal lt 0) then <debt/> else ()} &lt;{$c?c_nationkey} {{x}}</customer>""",
        """select '<customer id="' || c_custkey || '" seg="s-' || lower(c_mktsegment) || '"><name>' || c_name || '</name>' || case when c_acctbal < 0 then '<debt/>' else '' end || ' &lt;' || c_nationkey || ' {x}</customer>' item from customer""",
    ),
    "construct_computed": (
        """for $n in collection("nation") let $e := element { concat("n", $n?n_regionkey) } { attribute key { $n?n_nationkey }, $n?n_name, text { "&amp;" }, comment { "c" }, (1 to 3) }
           return map { "k": $n?n_nationkey, "xml": serialize($e), "value": string($e) }""",
        """select n_nationkey k, '<n' || n_regionkey || ' key="' || n_nationkey || '">' || n_name || '&amp;<!--c-->1 2 3</n' || n_regionkey || '>' as xml, n_name || '&1 2 3' as value from nation""",
    ),
    "json_xml": (
        """for $e in collection("events") let $x := json-to-xml($e?props) return map { "k": $e?event_id, "xml": serialize($x), "json": xml-to-json($x), "value": string($x) }""",
        """select event_id k, '<map xmlns="http://www.w3.org/2005/xpath-functions"><number key="k">' || json_extract_string(props, '$.k') || '</number></map>' as xml, '{"k":' || json_extract_string(props, '$.k') || '}' as json, json_extract_string(props, '$.k') as value from events""",
    ),
    "parse_xml": (
        """for $c in collection("customer") let $x := parse-xml(concat("<c n='", $c?c_custkey, "'><b>", $c?c_name, "</b>!</c>")) return map { "k": $c?c_custkey, "value": string($x), "xml": serialize(parse-xml-fragment(concat($c?c_name, "<i/>"))) }""",
        "select c_custkey k, c_name || '!' as value, c_name || '<i/>' as xml from customer",
    ),
    "string_constructor": ("""for $n in collection("nation") return ``[{"k": `{$n?n_nationkey}`, "n": "`{$n?n_name}`"}]``""", """select '{"k": ' || n_nationkey || ', "n": "' || n_name || '"}' item from nation"""),
    "typeswitch": (
        """for $p in collection("part") return map { "k": $p?p_partkey, "a": typeswitch ($p?p_size) case xs:string return "text" case $i as xs:integer return concat("n", $i) default return "?",
           "b": typeswitch ($p?p_name) case xs:integer | xs:double return 1 default $d return string-length($d) }""",
        "select p_partkey k, 'n' || p_size a, length(p_name)::bigint b from part",
    ),
    "order_collation": (
        """subsequence(for $p in collection("part") order by (if ($p?p_size mod 2 eq 0) then upper-case($p?p_name) else $p?p_name) collation "http://www.w3.org/2010/09/qt-fn/collation/caseblind", $p?p_partkey return $p?p_partkey, 1, 25)""",
        "select p_partkey item from part order by lower(p_name), p_partkey limit 25",
    ),
    "group_collation": (
        """for $p in collection("part") group by $n := (if ($p?p_size mod 2 eq 0) then upper-case($p?p_name) else $p?p_name) collation "http://www.w3.org/2010/09/qt-fn/collation/caseblind" return map { "n": upper-case($n), "c": count($p) }""",
        "select upper(p_name) n, count(*) c from part group by 1",
    ),
    "thesaurus": (
        """for $p in collection("part") return map { "k": $p?p_partkey, "t": string-join(ft:thesaurus-lookup(substring-before($p?p_name, " ")), ",") }""",
        "select p_partkey k, case split_part(p_name, ' ', 1) when 'small' then 'little,tiny,minute,compact' when 'big' then 'large,huge,enormous,vast' when 'large' then 'big,huge,enormous,vast' else '' end t from part",
    ),
    "window_tumbling_table": (
        """for $c in collection("conversations") group by $k := $c?conv_id let $t := sort($c?turn)
           for tumbling window $w in $t start at $s when true() end at $e when $e - $s eq 1 return map { "k": $k, "s": $s, "n": count($w), "x": sum($w) }""",
        """with t as (select conv_id k, turn, row_number() over (partition by conv_id order by turn) r from conversations)
           select k, (r - 1) // 2 * 2 + 1 s, count(*) n, sum(turn)::bigint x from t group by k, (r - 1) // 2""",
    ),
    "window_sliding_table": (
        """for $e in collection("events") group by $u := $e?user_id let $t := sort($e?event_id)
           for sliding window $w in $t start at $s when true() only end at $x when $x - $s eq 2 return map { "u": $u, "s": $s, "d": foot($w) - head($w) }""",
        """select u, s, d from (select user_id u, row_number() over w s, lead(event_id, 2) over w - event_id d from events window w as (partition by user_id order by event_id)) where d is not null""",
    ),
}
