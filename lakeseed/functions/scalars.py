"""Deterministic text, array, map and JSON functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters, in code point order.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: Column) -> Column:
    """Strip all Unicode white space, not only blanks, from both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def env_key(*parts: Column) -> Column:
    """Join parts into an upper-snake name.

    A separator comes before a part only once some earlier part was not blank, so
    leading blank parts vanish and later ones leave an underscore. Every code point
    outside A-Z, a-z and 0-9 becomes one underscore.
    """
    texts = [F.coalesce(part, F.lit("")) for part in parts]
    pieces: list[Column] = []
    started: Column | None = None
    for text in texts:
        if started is not None:
            pieces.append(F.when(started, "_").otherwise(""))
        pieces.append(text)
        filled = text != ""
        started = filled if started is None else started | filled
    return F.upper(F.regexp_replace(F.concat(*pieces), "[^A-Za-z0-9]", "_"))


def _replace_each(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda done, pair: F.replace(done, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def query_escape(text: Column) -> Column:
    """Percent-encode for a query string: only letters, digits and -_.~ stay, blank is +."""
    return _replace_each(F.url_encode(text), [("*", "%2A"), ("%7E", "~")])


def path_escape(text: Column) -> Column:
    """Percent-encode one path segment."""
    # Characters that a path segment may hold unescaped.
    kept = [("+", "%20"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@")]
    return _replace_each(query_escape(text), kept)


# Two private characters that hold the place of an escape, and the same escaped.
HELD, HELD_ESCAPED = "\ue000\ue001", "%EE%80%80%EE%80%81"


def _reescape(text: Column, kept: str) -> Column:
    """Decode and encode again, as a URL printer does with a part it cannot keep.

    ``kept`` are the reserved characters that this part may hold unescaped. Escaped bytes
    beyond ASCII stay escaped, so bytes that are no UTF-8 text are not lost.
    """
    upper = text
    for letter in 2 * "abcdef":
        upper = F.regexp_replace(upper, f"(%[0-9A-Fa-f]?){letter}", f"$1{letter.upper()}")
    held = F.regexp_replace(F.replace(upper, F.lit("+"), F.lit("%2B")), "%([89A-F][0-9A-F])", f"{HELD}$1")
    pairs = [("+", "%20"), *[(f"%{ord(letter):02X}", letter) for letter in kept], (HELD_ESCAPED, "%")]
    return _replace_each(query_escape(F.url_decode(held)), pairs)


def _reescape_user(user: Column) -> Column:
    """Name and password in front of a host, each encoded again."""
    text = F.regexp_replace(user, "@$", "")
    name = _reescape(F.substring_index(text, ":", 1), USER_KEEPS)
    password = _reescape(F.regexp_replace(text, "^[^:]*:", ""), USER_KEEPS)
    return F.concat(name, F.when(text.contains(":"), F.concat(F.lit(":"), password)).otherwise(""), F.lit("@"))


# Fixed patterns: the parts of an absolute URL.
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
USER = r"(?:[A-Za-z0-9\-._:~!$&'()*+,;=%@]*@)?"
HOST = r"(?:\[[^\]/?#@]+\]|[^/?#@:\[\]\s^`{|}\\%]+)(?::[0-9]*)?|:[0-9]*"
URL = rf"(?s)^{SCHEME}://({USER})(?:{HOST})((?:/[^?#]*)?)((?:\?[^#]*)?)((?:#.*)?)$"
# Fixed patterns: characters that force a part to be encoded again.
ODD_PATH = r"[^A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/%]"
ODD_FRAGMENT = r"[^A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/%?]"
ODD_USER = r"[!'()*%]|@.*@|:.*:"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
# Reserved characters that each part may hold unescaped.
USER_KEEPS = "$&+,;="
PATH_KEEPS = "$&+,/:;=@"
FRAGMENT_KEEPS = "!$&()*+,/:;=?@"
CONTROL = r"[\x00-\x1f\x7f]"


def rewrite_endpoint(url: Column, endpoint: str) -> Column:
    """Put the scheme and host of ``endpoint`` into ``url``.

    User name, path, query and fragment stay. Text that is not an absolute URL, or
    that does not parse, comes back unchanged.
    """
    target = re.match(rf"^({SCHEME})://(?:[^/?#]*@)?([^/?#]+)", endpoint)
    if target is None:
        return url
    prefix = target.group(1).lower() + "://"
    host = target.group(2)

    user = F.regexp_extract(url, URL, 1)
    path = F.regexp_extract(url, URL, 2)
    fragment = F.substring(F.regexp_extract(url, URL, 4), 2, 2**31 - 1)
    head_and_path = F.regexp_replace(url, r"(?s)[?#].*$", "")
    parses = (
        url.rlike(URL)
        & ~url.rlike(CONTROL)
        & ~head_and_path.rlike(BAD_ESCAPE)
        & ~fragment.rlike(BAD_ESCAPE)
    )
    odd_parts = user.rlike(ODD_USER) | path.rlike(ODD_PATH) | fragment.rlike(ODD_FRAGMENT)
    plain = ~odd_parts & ~url.endswith("#")
    literal_host = host.replace("\\", "\\\\").replace("$", "\\$")
    simple = F.regexp_replace(url, URL, f"{prefix}$1{literal_host}$2$3$4")
    new_user = F.when(user.rlike(ODD_USER), _reescape_user(user)).otherwise(user)
    new_path = F.when(path.rlike(ODD_PATH), _reescape(path, PATH_KEEPS)).otherwise(path)
    new_fragment = F.when(
        fragment.rlike(ODD_FRAGMENT), _reescape(fragment, FRAGMENT_KEEPS)
    ).otherwise(fragment)
    rebuilt = F.concat(
        F.lit(prefix),
        new_user,
        F.lit(host),
        new_path,
        F.regexp_extract(url, URL, 3),
        F.when(fragment != "", F.concat(F.lit("#"), new_fragment)).otherwise(""),
    )
    return F.when(~parses, url).when(plain, simple).otherwise(rebuilt)


def strip_registry(image: Column) -> Column:
    """Drop the registry host in front of an image path.

    The part before the first slash is a host if it has a dot or a colon or is
    ``localhost``.
    """
    trimmed = trim_space(image)
    head = F.substring_index(trimmed, "/", 1)
    is_host = head.rlike("[.:]") | (head == "localhost")
    return F.when(
        (F.instr(trimmed, "/") > 0) & is_host, F.regexp_replace(trimmed, "(?s)^[^/]*/", "")
    ).otherwise(trimmed)


def registry_image(image: Column, address: str) -> Column:
    """Put a registry address in front of an image, in place of the host it had."""
    if not address:
        return image
    return F.when(image == "", image).otherwise(F.concat(F.lit(f"{address}/"), strip_registry(image)))


def overlay(base: Column, top: Column) -> Column:
    """Merge two maps; ``top`` wins. Needs no session setting for duplicate keys."""
    kept = F.map_filter(base, lambda key, _: ~F.map_contains_key(top, key))
    return F.map_concat(kept, top)


def unique_tokens(tokens: Column) -> Column:
    """Trim the tokens, drop blank ones and repeats in order, join with commas."""
    trimmed = F.transform(tokens, trim_space)
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda token: token != "")), ",")


def property_lines(properties: Column) -> Column:
    """Sorted ``key=value`` lines; whole lines are compared, not keys."""
    lines = F.transform(
        F.map_entries(properties), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"])
    )
    return F.concat(F.array_join(F.array_sort(lines), "\n"), F.lit("\n"))


def first_filled(*texts: Column) -> Column:
    """The first text that is not empty, else the empty text; blanks are not trimmed."""
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts], F.lit(""))


def json_without_blanks(
    always: dict[str, Column],
    texts: dict[str, Column] | None = None,
    nested: dict[str, Column] | None = None,
) -> Column:
    """JSON text of a record; empty ``texts`` and empty ``nested`` fields are left out.

    ``always`` fields appear whatever they hold, as ``null`` if need be.
    """
    required = F.to_json(F.struct(*[value.alias(name) for name, value in always.items()]), {"ignoreNullFields": "false"})
    fields = [F.nullif(value, F.lit("")).alias(name) for name, value in (texts or {}).items()]
    fields += [F.when(F.size(value) > 0, value).alias(name) for name, value in (nested or {}).items()]
    if not fields:
        return required
    optional = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    members = [F.regexp_replace(part, r"^\{|\}$", "") for part in ((required, optional) if always else (optional,))]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.nullif(part, F.lit("")) for part in members]), F.lit("}"))


def variant_kind(value: Column) -> Column:
    """Type name of a variant with sizes and nested fields cut off."""
    return F.regexp_replace(F.schema_of_variant(value), r"^(DECIMAL|OBJECT)[(<].*$", "$1")


def document_store_dsn(host: Column, user: Column, password: Column, database: Column) -> Column:
    """Connection text of a document store with escaped credentials and database."""
    # The scheme, the default database and the option of the connection text.
    plain = F.concat(
        F.lit("mongodb://"),
        host,
        F.when(database != "", F.concat(F.lit("/"), path_escape(database))).otherwise(""),
    )
    signed = F.concat(
        F.lit("mongodb://"),
        query_escape(user),
        F.lit(":"),
        query_escape(password),
        F.lit("@"),
        host,
        F.lit("/"),
        path_escape(first_filled(database, F.lit("admin"))),
        F.lit("?authSource=admin"),
    )
    return F.when((user == "") & (password == ""), plain).otherwise(signed)
