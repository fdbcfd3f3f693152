"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from . import chat_format as c, fill_middle as f, quality_lines as q, source_mixing as m

_WHITE = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"[x for x in string_split(translate({{}}, {_WHITE}, '     '), ' ') if x <> '']"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, {_text(characters)}, '')))"


def _any(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, {_text(p)})" for p in phrases) + ")"


_CLOSING = "chr(9) || chr(13) || " + _text(q.CLOSING.translate({9: None, 13: None}))
_TRIMMED = f"trim(line, ' ' || {_WHITE})"

QUALITY = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
rows as (select doc_id, text, {_WORDS.format("text")} as words, string_split(text, chr(10)) as lines from docs),
grams as (
    select doc_id, unnest(range(1, len(words) - 1)) as i, words from rows where len(words) >= 3
),
repeated as (
    select doc_id, i from (
        select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from grams
    ) where n > 1
),
covered as (
    select doc_id, count(distinct place) as n_repeat_words
    from (select doc_id, unnest([i, i + 1, i + 2]) as place from repeated) group by doc_id
),
lines as (
    select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from rows
),
measured as (
    select *, lower(line) as low,
        case when {_TRIMMED} = '' then 0 else {_count(_TRIMMED, " ")} + 1 end as n,
        {_count("line", q.SYMBOLS)} as symbols, {_count("line", q.SEPARATORS)} as separators
    from lines
),
ruled as (
    select *, n = 0 or not (
        separators * {q.WORDS_PER_SEPARATOR} >= greatest(n, {q.WORDS_PER_SEPARATOR})
        or symbols > 0 and symbols * 3 >= n
        or n >= {q.SHOUTED_WORDS} and right(line, 8) <> right(low, 8) and line = upper(line)
        or n < {q.LONG_LINE} and right(rtrim(line, {_CLOSING}), 1) not in ({", ".join(map(_text, q.END_MARKS))})
        or {_any("low", q.BOILERPLATE)}
    ) as passed
    from measured
),
by_line as (
    select doc_id, count(*) as n_lines, count(*) filter (not passed) as n_removed_lines,
        count(*) filter (n > 0) - count(distinct case when n > 0 then line end) as n_dup_lines,
        sum(case when passed then 0 else length(translate(line, ' ' || {_WHITE}, '')) end)::bigint as lost_chars
    from ruled group by doc_id
),
counted as (
    select doc_id, len(words) as n_words, length(translate(text, ' ' || {_WHITE}, '')) as word_chars,
        {_count("text", q.SYMBOLS)} as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        n_lines, n_removed_lines, lost_chars
    from rows join by_line using (doc_id) left join covered using (doc_id)
),
judged as (
    select *, n_words < {q.LEAST_WORDS} or 100 * n_repeat_words > {q.MOST_REPEATED} * n_words as base_failed from counted
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, n_lines::bigint as n_lines,
    n_removed_lines::bigint as n_removed_lines, lost_chars, base_failed,
    not base_failed and lost_chars * 100 <= {q.MOST_LOST} * word_chars as kept
from judged
"""


def _mixing() -> str:
    """Raking, written out for all rounds."""
    size, dims = "length(text)", ", ".join(m.DIMENSIONS)
    parts = [
        f"""docs as materialized (
    select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
        case when {_count("text", "|")} * 50 > {size} then 'list'
            when {_count("text", "#*$%&<>{}=;")} * 20 > {size} then 'symbols'
            when {size} < 600 then 'note' when {size} < 6000 then 'article' else 'long read' end as topic,
        greatest(len({_WORDS.format("text")}), 1) as tokens
    from (select doc_id, source, lang, coalesce(text, '') as text from documents)
)""",
        f"cells as (select {dims}, sum(tokens)::double as tokens from docs group by all)",
    ]
    for d in m.DIMENSIONS:
        parts.append(f"parts_{d} as (select {d}, pow(sum(tokens), {m.SMOOTHING}) as part from cells group by {d})")
        parts.append(f"targets_{d} as (select {d}, part / (select sum(part) from parts_{d}) as target_{d} from parts_{d})")
    joins = " ".join(f"join targets_{d} using ({d})" for d in m.DIMENSIONS)
    parts.append(f"step_0 as materialized (select *, tokens as weight from cells {joins})")
    step = 0
    for _ in range(m.ROUNDS):
        for d in m.DIMENSIONS:
            scaled = f"weight * (target_{d} / sum(weight) over (partition by {d}))"
            parts.append(f"step_{step + 1} as materialized (select * exclude (weight), {scaled} as weight from step_{step})")
            step += 1
    # With the m cells of the largest ratios whole, the factor is what the others need to reach the rate; the first
    # m that leaves no other above 1 is the right one.
    upto = "over (order by ratio desc, source, lang, topic rows unbounded preceding)"
    parts.append(f"ratios as (select {dims}, tokens, weight / tokens as ratio from step_{step})")
    parts.append(f"ordered as (select *, sum(tokens) {upto} - tokens as whole, sum(tokens * ratio) {upto} - tokens * ratio as above from ratios)")
    parts.append(
        f"factors as (select ratio, ({m.RATE} * (select sum(tokens) from ratios) - whole) / ((select sum(tokens * ratio) from ratios) - above) as k from ordered)"
    )
    parts.append("factor as (select first(k order by ratio desc) as k from factors where k * ratio <= 1)")
    parts.append(f"chances as (select {dims}, least(1.0, ratio * (select k from factor)) as probability from ratios)")
    key = "coalesce(doc_id::varchar, 'null')"
    parts.append(
        f"drawn as (select *, ('0x' || substr(md5('{m._SEED}:' || {key}), 1, 13))::ubigint::double / {m._HASH_RANGE}::double as drawn from docs)"
    )
    return "with " + ",\n".join(parts) + f"""
select doc_id, {dims}, tokens::bigint as tokens, round(probability, 6) as probability, round(drawn, 6) as drawn,
    drawn < probability as kept
from drawn join chances using ({dims})"""


MIXING = _mixing()

EXACT_DEDUP = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id is not distinct from max(doc_id) over same as kept, sha256(text) as text_sha256
from (select doc_id, coalesce(text, '') as text from documents)
window same as (partition by text)
"""


def _chat() -> str:
    """Formatting keeps every turn, so reading it back gives the turns of the table."""
    escape = _text(c.patterns()[0])
    extra = "</s>[INST] ok [/INST]"
    block = len(c.CHAT.start + c.CHAT.body + c.CHAT.end + c.CHAT.after)
    return f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '{extra}'), (-7, 1, 'assistant', '{extra}')
),
placed as (
    select *, length(regexp_replace(text, {escape}, '\\1\\\\\\2', 'g')) as size,
        length(regexp_replace(role, {escape}, '\\1\\\\\\2', 'g')) as role_size,
        lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as opens
    from turns
),
chats as (
    select conv_id, count(*) as n_turns,
        string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as spoken,
        coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
        sum(size + case when opens then role_size + {block} else {len(c.CHAT.join)} end) as formatted_chars,
        count(*) filter (opens) as n_blocks
    from placed group by conv_id
)
select conv_id, n_turns::bigint as n_turns, sha256(spoken) as turns_sha256, length(loss)::bigint as loss_chars,
    sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars, n_blocks::bigint as n_blocks
from chats
"""


CHAT = _chat()

FILL_MIDDLE = f"""
with texts as (
    select doc_id, coalesce(text, '') as text, sha256('{f.SEED}:' || coalesce(doc_id::varchar, 'null')) as h from documents
),
lines as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units from texts),
drawn as (
    select *, len(units) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2,
        ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4
    from lines
),
cut as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
        case when {" or ".join(f"contains(text, '{mark}')" for mark in f.MARKS)} or text = '' or h3 % 100 >= {f.RATE}
            then 'plain' when h4 % 100 < {f.SUFFIX_FIRST} then 'spm' else 'psm' end as form
    from drawn
),
parts as (
    select *, array_to_string(units[1:low], '') as prefix, array_to_string(units[low + 1:high], '') as middle,
        array_to_string(units[high + 1:], '') as suffix
    from cut
)
select doc_id, n::bigint as n, form,
    case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
    case when form <> 'plain' then length(middle) end::bigint as middle_chars,
    sha256(case form when 'plain' then text
        when 'psm' then '{f.PREFIX}' || prefix || '{f.SUFFIX}' || suffix || '{f.MIDDLE}' || middle
        else '{f.SUFFIX}' || suffix || '{f.PREFIX}' || prefix || '{f.MIDDLE}' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from parts
"""
