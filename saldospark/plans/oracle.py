"""SQL for DuckDB, as common table expressions that build on each other.

The statements use other methods than the Spark plans where they can: ranked LIKE search for prefixes, one join over
rules for patterns, nested list reductions for similarity.
"""

from __future__ import annotations

from saldospark.plans.ledger import DICTIONARY, LEDGER_SQL
from saldospark.rules import catalog as C
from saldospark.rules import patterns, prefixes, special


def q(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


def any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def norm(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


CATALOG = values("catalogo", "codigo_estandar, nombre_estandar, categoria", [r[:3] for r in C.rows()])
DICT = values("diccionario", "cuenta_original, codigo_estandar, fuente, seq", [(*d, i) for i, d in enumerate(DICTIONARY)])
PREFIXES = values("prefijos", "fmt, patron, code, conf, largo, ord", [
    (fmt, "^" + p.replace(".", "\\."), code, conf, len(p), i) for fmt, listed in prefixes.LISTED.items() for i, (p, code, conf) in enumerate(listed)
])
RULES = values("reglas", "ord, code, conf, pat", [(i, code, conf, p) for i, (p, code, conf) in enumerate(patterns.RULES)])

LOOSE = "case when coalesce({0}, '') = '' then 'sin_codigo' when regexp_matches({0}, '^\\d+-\\d+') then 'guion' when regexp_matches({0}, '^\\d+\\.\\d+') then 'punto' when regexp_matches({0}, '^\\d{{6,10}}$') then 'compacto' else 'desconocido' end"
NAMED = f"nombrado as (select *, {norm('nombre')} as nombre_norm, {LOOSE.format('codigo')} as cod_formato from ledger)"
CODE_HITS = """codigos as (
    select c.codigo, arg_min(p.code, -p.largo * 1000 + p.ord) as cod_codigo, arg_min(p.conf, -p.largo * 1000 + p.ord)::double as cod_confianza
    from (select distinct codigo, cod_formato from nombrado where codigo is not null) c join prefijos p on p.fmt = c.cod_formato and regexp_matches(c.codigo, p.patron) group by c.codigo)"""
DICT_KEYS = f"""claves as (
    select clave, arg_max(codigo_estandar, seq) as dic_codigo, min(seq) as pos from (select *, {norm('cuenta_original')} as clave from diccionario) group by clave)"""
NAMES = "nombres as (select distinct nombre_norm from nombrado)"
RULE_HITS = """por_regla as (
    select nombre_norm, arg_max(code, round(conf * 100) * 1000 - ord) as re_code, max(conf)::double as re_conf
    from nombres join reglas on regexp_matches(nombre_norm, pat, 'i') group by nombre_norm)"""
SORTED = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"
FUZZY = f"""pares as (
    select nombre_norm, clave, dic_codigo, pos, {SORTED.format('nombre_norm')} as a, {SORTED.format('clave')} as b from nombres cross join claves where nombre_norm <> ''
), medidos as (
    select *, list_reduce(list_transform(string_split(a, ''), lambda c: [ord(c)]),
        lambda fila, c: list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::integer]),
            lambda ahora, j: list_append(ahora, case when ord(string_split(b, '')[j[1]]) = c[1] then fila[j[1]] + 1 else greatest(fila[j[1] + 1], ahora[j[1]]) end), [0]),
        list_transform(range(0, len(b) + 1), lambda x: 0)) as fila from pares
), difusos as (
    select nombre_norm, arg_max(dic_codigo, puntaje * 100000 - pos) as fuz_codigo, arg_max(clave, puntaje * 100000 - pos) as fuz_clave, max(puntaje) as fuz_puntaje
    from (select *, 200.0::double * fila[-1] / (len(a) + len(b)) as puntaje from medidos) where puntaje >= 90 group by nombre_norm)"""


def correction(name: str, code: str, origin: str, amount: str) -> str:
    income, expense = (f"{origin} in {side}" for side in (special.INCOME_SIDE, special.EXPENSE_SIDE))
    parts = [f"case when {amount} < 0 and {origin} = 'activo' and {code} = 'AC.01' and {any_of(name, special.OVERDRAFT_WORDS)} then 'PC.02' end"]
    parts += [f"case when contains({name}, '{w}') and {code} not in ('{a}', '{b}') then case when {income} then '{a}' when {expense} then '{b}' end end" for w, a, b in special.AMBIGUOUS_WORDS]
    return "coalesce(" + ", ".join(parts) + ")"


def ambiguous(name: str, origin: str) -> str:
    whens = [f"when {name} = '{n}' and {origin} in {side} then '{code}'" for n, codes in special.AMBIGUOUS_NAMES.items() for side, code in zip((special.INCOME_SIDE, special.EXPENSE_SIDE), codes)]
    return "case " + " ".join(whens) + " end"


def rule_conditions(name: str, code: str, amount: str, activity: str) -> list[tuple[str, str, str]]:
    n = f"trim(lower({name}))"
    return list(zip((
        f"({code} = 'AC.01' or {any_of(n, special.BANK_WORDS)}) and {amount} < 0",
        f"regexp_matches({n}, {q(special.LAND)}) and {code} = 'ANC.01' and {any_of(f'lower({activity})', special.PROPERTY_SECTORS)}",
        f"regexp_matches({n}, {q(special.DEFERRED_INCOME)}) and (starts_with({code}, 'AC') or starts_with({code}, 'ANC'))",
        f"({code} in ('AC.03', 'AC.04') or {any_of(n, special.CLIENT_WORDS)}) and {amount} < 0",
        f"regexp_matches({n}, {q(special.SHAREHOLDER)})",
    ), ("PC.02", "AC.05", "PC.08", "PC.08", "AC.06S"), special.FLAGS))


def rules_case(name: str, code: str, amount: str, activity: str, what: int) -> str:
    return "case " + " ".join(f"when {r[0]} then '{r[what]}'" for r in rule_conditions(name, code, amount, activity)) + " end"


CASCADE = f"""etapas as (
    select n.*, {ambiguous('n.nombre_norm', 'n.origen_columna')} as amb, coalesce(cod_codigo, dic_codigo, fuz_codigo, re_code) as c0,
        case when cod_codigo is not null then 'codigo' when dic_codigo is not null then 'diccionario_exacto' when fuz_codigo is not null then 'diccionario_fuzzy'
            when re_code is not null then 'regla_regex' else 'sin_clasificar' end as m0,
        case when cod_codigo is not null then cod_confianza when dic_codigo is not null then 0.98 when fuz_codigo is not null then round_even(0.80 + (fuz_puntaje - 90) * 0.01, 3)
            when re_code is not null then re_conf else 0.0 end::double as k0
    from nombrado n left join codigos using (codigo) left join claves on clave = n.nombre_norm left join difusos using (nombre_norm) left join por_regla using (nombre_norm)
), corregidas as (
    select *, case when origen_columna <> 'desconocido' and c0 is not null then nullif({correction('nombre_norm', 'c0', 'origen_columna', 'monto')}, c0) end as fix from etapas
), regladas as (
    select *, coalesce(fix, c0) as c1, {rules_case('nombre', "coalesce(fix, c0, 'AC.08')", 'monto', 'giro', 1)} as sp, {rules_case('nombre', "coalesce(fix, c0, 'AC.08')", 'monto', 'giro', 2)} as flag from corregidas
), finales as (
    select doc_id, linea, coalesce(codigo, '') as codigo_original, nombre as nombre_original, nombre_norm, monto, origen_columna, es_total,
        coalesce(case when amb is not null then amb when sp is not null then sp else c1 end, '') as codigo_clasificado,
        case when amb is not null then 'columna_ambiguo' else m0 || case when fix is not null then '+columna' else '' end || case when sp is not null then '+regla_especial(' || flag || ')' else '' end end as metodo,
        case when amb is not null then 0.88 when fix is not null then least(k0 + 0.05, 0.99) else k0 end::double as confianza,
        case when amb is null and sp is not null then flag else '' end as nota from regladas
), resultado as (select *, confianza < 0.85 as requiere_revision from finales)"""

BASE = [LEDGER_SQL, CATALOG, DICT, PREFIXES, RULES, NAMED, CODE_HITS, DICT_KEYS, NAMES, RULE_HITS, FUZZY, CASCADE]
CLASSIFIED = "clasificadas as (select * from resultado where codigo_clasificado not in ('', '__EXCLUIR__') and not es_total)"
BALANCE = """agrupado as (
    select codigo_clasificado, cast(sum(cast(coalesce(monto, 0) as decimal(20,2))) as double) as monto_total, count(nombre_original) as num_cuentas from clasificadas group by all
), balance as (
    select g.*, coalesce(nombre_estandar, codigo_clasificado) as nombre_estandar, coalesce(categoria, '') as categoria,
        coalesce(list_position(['activo_corriente', 'activo_no_corriente', 'pasivo_corriente', 'pasivo_no_corriente', 'patrimonio', 'resultado'], categoria) - 1, 99)::integer as orden
    from agrupado g left join catalogo on codigo_estandar = codigo_clasificado)"""


def over(body: str, *more: str, base: list[str] = BASE) -> str:
    return "with " + ", ".join([*base, *more]) + " " + body


def over_result(body: str, *more: str) -> str:
    return over(body, CLASSIFIED, BALANCE, *more)


def over_ledger(body: str, *more: str) -> str:
    return over(body, *more, base=[LEDGER_SQL])
