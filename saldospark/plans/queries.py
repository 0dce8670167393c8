"""The queries of the library and their SQL for DuckDB, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.functions import tables as table_functions
from saldospark.functions.plan import broadcast_if_small, cut, fence, shared_folder
from saldospark.operators import balance as B
from saldospark.operators import classify as C
from saldospark.operators import feedback as H
from saldospark.operators import metadata as M
from saldospark.operators import parse as P
from saldospark.operators import profile as R
from saldospark.operators import risk as K
from saldospark.operators import terms as S
from saldospark.operators.similar import similar_pairs
from saldospark.plans import oracle as O
from saldospark.plans.ledger import LEDGER_SQL, ledger, seed_dictionary
from saldospark.rules import patterns, special
from saldospark.rules.catalog import NAMES, SECTIONS, catalog
from saldospark.schemas import EXCLUDED
from saldospark.sources import ordered, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _named(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ledger (or the given columns of it) with ``nombre_norm``, worked out once for each row however often a query names it."""
    return fence(ledger(spark, sf_dir).select(*columns or "*", T.normalize_name(F.col("nombre")).alias("nombre_norm")))


def _result(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ledger's result table, or the given columns of it."""
    return C.classified(ledger(spark, sf_dir), seed_dictionary(spark), activity="giro", columns=columns)


_SUMS = ("codigo_clasificado", "monto", "es_total")
_OPEN = ("doc_id", "linea", "nombre_original", "codigo_clasificado", "metodo", "confianza", "requiere_revision")


# --- balance and reconciliation -------------------------------------------------------------------------------


@query(O.over_result("select codigo_clasificado, nombre_estandar, categoria, orden, monto_total, num_cuentas from balance"))
def balance_by_code(spark, sf_dir):
    return B.balance(_result(spark, sf_dir, *_SUMS, "nombre_original"), catalog(spark))


@query(O.over_result("""
    select categoria, codigo_clasificado, cast(sum(cast(coalesce(monto, 0) as decimal(20,2))) as double) as monto_total, count(nombre_original) as num_cuentas,
        cast(grouping(categoria, codigo_clasificado) as integer) as nivel
    from (select c.*, coalesce(k.categoria, '') as categoria from clasificadas c left join catalogo k on codigo_estandar = codigo_clasificado)
    group by rollup (categoria, codigo_clasificado)"""))
def balance_rollup_category(spark, sf_dir):
    return B.balance_rollup(_result(spark, sf_dir, *_SUMS, "nombre_original"), catalog(spark))


@query(O.over_result(f"""
    select orden, ([{', '.join(map(O.q, SECTIONS))}])[1 + orden] as titulo, codigo_clasificado as codigo, nombre_estandar as cuenta, monto_total, num_cuentas,
        cast(sum(cast(monto_total as decimal(20,2))) over (partition by orden) as double) as subtotal from balance where orden < 99"""))
def balance_sections(spark, sf_dir):
    return B.balance_sections(_result(spark, sf_dir, *_SUMS, "nombre_original"), catalog(spark))


@query(O.over_result("select codigo_clasificado as codigo, nombre_estandar as cuenta, cast(round_even(monto_total, 0) as bigint) as monto, num_cuentas from balance"))
def balance_export(spark, sf_dir):
    return B.balance_export(_result(spark, sf_dir, *_SUMS, "nombre_original"), catalog(spark))


@query(O.over_result("""
    select doc_id, linea, codigo_clasificado, coalesce(nombre_estandar, codigo_clasificado) as nombre_estandar, nombre_original, monto,
        cast(cast(round_even(confianza * 100, 0) as integer) as varchar) || '%' as confianza_pct
    from clasificadas left join catalogo on codigo_estandar = codigo_clasificado"""))
def balance_detail_sorted(spark, sf_dir):
    return B.account_detail(_result(spark, sf_dir, *_SUMS, "doc_id", "linea", "nombre_original", "confianza"), catalog(spark))


@query(O.over_result("select doc_id, linea, row_number() over (order by codigo_clasificado, abs(monto) desc nulls last, doc_id, linea) as lugar from clasificadas"))
def detail_in_order(spark, sf_dir):
    """The place of each account in the exported detail: by file and row, over files written in order."""
    path = f"{shared_folder(spark)}/detalle-{uuid.uuid4().hex}"
    # read by a count, by the sample of the range partitioning and by the sort
    detail = cut(B.account_detail(_result(spark, sf_dir, *_SUMS, "doc_id", "linea", "nombre_original", "confianza"), catalog(spark)))
    ordered.write_ordered(detail, path, B.detail_order(), ordered.files_for(detail))
    return ordered.read_places(spark, path).select("doc_id", "linea", "lugar")


@query(O.over_result("""
    select doc_id, round(pat, 2) as patrimonio_contable, round(abs(m), 2) as ajuste_cta_socios, round(pat - abs(m), 2) as patrimonio_efectivo, m > 0 as tiene_ajuste, m > pat * 0.2::double as alerta
    from (select doc_id, cast(sum(case when codigo_clasificado in ('PAT.01', 'PAT.02', 'PAT.03', 'PAT.04') then cast(coalesce(monto, 0) as decimal(20,2)) else 0 end) as double) as pat,
            cast(sum(case when codigo_clasificado = 'AC.06S' then cast(coalesce(monto, 0) as decimal(20,2)) else 0 end) as double) as m,
            count(*) filter (where starts_with(codigo_clasificado, 'PAT')) as n from clasificadas group by doc_id) where n > 0"""))
def effective_equity(spark, sf_dir):
    return B.effective_equity(_result(spark, sf_dir, "doc_id", *_SUMS), by=("doc_id",))


_ORIGIN_SQL = ", ".join(f"cast(coalesce(sum(cast(monto as decimal(20,2))) filter (where not es_total and origen_columna = '{o}'), 0) as double) as {o}" for o in ("activo", "pasivo", "perdida", "ganancia"))


@query(O.over_ledger(f"""
    select *, round(abs((activo - pasivo) - (ganancia - perdida)), 2) as diferencia, abs((activo - pasivo) - (ganancia - perdida)) < 10 as cuadra,
        case when abs((activo - pasivo) - (ganancia - perdida)) >= 10 then format('CONTROL DE CUADRE FALLIDO: Activos ({{:,.0f}}) - Pasivos ({{:,.0f}}) | Ganancias ({{:,.0f}}) - Pérdidas ({{:,.0f}}). Diferencia: {{:,.0f}}',
            activo, pasivo, ganancia, perdida, abs((activo - pasivo) - (ganancia - perdida))) end as alerta
    from (select doc_id, {_ORIGIN_SQL} from ledger group by doc_id)"""))
def tieout_balance(spark, sf_dir):
    return B.balance_check(ledger(spark, sf_dir))


_PROFIT_SQL = """utilidad as (
    select doc_id, er11, pat04, diferencia, case when er11 is null and pat04 is null then 'sin_datos' when er11 is null then 'sin_er11' when pat04 is null then 'sin_pat04'
        when diferencia <= 1000 then 'cuadra' else 'descuadre' end as estado
    from (select *, round(abs(er11 - pat04), 2) as diferencia from (
        select doc_id, cast(sum(cast(coalesce(monto, 0) as decimal(20,2))) filter (where codigo_clasificado = 'ER.11') as double) as er11,
            cast(sum(cast(coalesce(monto, 0) as decimal(20,2))) filter (where codigo_clasificado = 'PAT.04') as double) as pat04
        from clasificadas group by doc_id)))"""


@query(O.over_result("select * from utilidad", _PROFIT_SQL))
def tieout_profit(spark, sf_dir):
    return B.profit_check(_result(spark, sf_dir, "doc_id", *_SUMS), by=("doc_id",))


@query(O.over_result("select codigo_clasificado, nombre_estandar, monto_total from balance where starts_with(codigo_clasificado, 'ER')"))
def tieout_diag_er(spark, sf_dir):
    return B.result_detail(_result(spark, sf_dir, *_SUMS, "nombre_original"), catalog(spark))


@query(O.over_result("""
    select doc_id, linea, nombre_original, monto, codigo_clasificado from clasificadas join utilidad using (doc_id)
    where estado = 'descuadre' and abs(abs(monto) - diferencia) <= greatest(diferencia * 0.05::double, 1000)""", _PROFIT_SQL))
def tieout_diag_candidates(spark, sf_dir):
    result = cut(_result(spark, sf_dir, "doc_id", "linea", "nombre_original", *_SUMS))  # read twice
    return B.sign_candidates(result, B.profit_check(result, by=("doc_id",)))


def _marked(spark, sf_dir):
    """The result after reviewers excluded one kind of account."""
    result = cut(_result(spark, sf_dir, *_OPEN, "monto"))  # read twice
    fixes = result.where("nombre_original = 'Cuenta Puente X' and linea % 2 = 0").select("doc_id", "linea", F.lit(H.LABELS["skip"]).alias("codigo_nuevo"))
    return H.apply_corrections(result, fixes)


@query(O.over_result("select doc_id, linea, nombre_original, monto from resultado where nombre_original = 'Cuenta Puente X' and linea % 2 = 0"))
def tieout_diag_excluded(spark, sf_dir):
    return B.excluded(_marked(spark, sf_dir)).select("doc_id", "linea", "nombre_original", "monto")


@query("""
    select o_orderkey, round(o_totalprice, 2) as pedido, lineas, abs(round(o_totalprice, 2) - lineas) <= 1000 as cuadra
    from orders join (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(20,2))) as double) as lineas from lineitem group by l_orderkey) on l_orderkey = o_orderkey""")
def tieout_orders(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum(T.exact(F.col("l_extendedprice"))).cast("double").alias("lineas"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round("o_totalprice", 2).alias("pedido"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select("o_orderkey", "pedido", "lineas", (F.abs(F.col("pedido") - F.col("lineas")) <= B.PROFIT_TOLERANCE).alias("cuadra"))


# --- classification -------------------------------------------------------------------------------------------


@query(O.over("select doc_id, linea, codigo, cod_codigo, cod_confianza from nombrado left join codigos using (codigo)"))
def classify_code_prefix(spark, sf_dir):
    return C.by_code_prefix(ledger(spark, sf_dir)).select("doc_id", "linea", "codigo", "cod_codigo", "cod_confianza")


@query(O.over("select cod_formato, count(*) as n, avg(case when cod_codigo is null then 0.0::double else 1.0::double end) as cobertura from nombrado left join codigos using (codigo) group by cod_formato"))
def classify_code_format(spark, sf_dir):
    hit = F.avg(F.col("cod_codigo").isNotNull().cast("double")).alias("cobertura")
    return C.by_code_prefix(ledger(spark, sf_dir)).groupBy("cod_formato").agg(F.count("*").alias("n"), hit)


@query(O.over("select doc_id, linea, nombre_norm, dic_codigo from nombrado left join claves on clave = nombre_norm"))
def classify_dict_exact(spark, sf_dir):
    return C.by_dictionary(_named(spark, sf_dir, "doc_id", "linea"), seed_dictionary(spark)).select("doc_id", "linea", "nombre_norm", "dic_codigo")


@query(O.over("select nombre_norm, fuz_codigo, fuz_clave, round(fuz_puntaje, 6) as fuz_puntaje from difusos"))
def classify_dict_fuzzy(spark, sf_dir):
    return C.fuzzy_matches(_named(spark, sf_dir, "nombre"), seed_dictionary(spark)).withColumn("fuz_puntaje", F.round("fuz_puntaje", 6))


_PART_PAIRS = """
    with p as (select distinct p_name from part), d as (select distinct p_name as clave from part),
    c as (select p_name, clave, """ + O.SORTED.format("p_name") + " as a, " + O.SORTED.format("clave") + """ as b from p cross join d where p_name <> clave),
    m as (select *, list_reduce(list_transform(string_split(a, ''), lambda c: [ord(c)]),
        lambda fila, c: list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::integer]),
            lambda ahora, j: list_append(ahora, case when ord(string_split(b, '')[j[1]]) = c[1] then fila[j[1]] + 1 else greatest(fila[j[1] + 1], ahora[j[1]]) end), [0]),
        list_transform(range(0, len(b) + 1), lambda x: 0)) as fila from c)
    select p_name, clave, round(200.0::double * fila[-1] / (len(a) + len(b)), 6) as puntaje from m where 200.0::double * fila[-1] / (len(a) + len(b)) >= 75"""


@query(_PART_PAIRS)
def name_similarity(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet")
    a = names.select("p_name").distinct().withColumn("_a", T.token_sort(F.col("p_name")))
    b = names.select(F.col("p_name").alias("clave")).distinct().withColumn("_b", T.token_sort(F.col("clave")))
    return similar_pairs(a, b, "_a", "_b", 75.0).where("p_name <> clave").select("p_name", "clave", F.round("puntaje", 6).alias("puntaje"))


@query(O.over("select doc_id, linea, nombre_norm, re_code as codigo_regla, re_conf as confianza_regla from nombrado left join por_regla using (nombre_norm)"))
def classify_regex_argmax(spark, sf_dir):
    rule = C.regex_rule(F.col("nombre_norm"))
    named = _named(spark, sf_dir, "doc_id", "linea")
    rules = named.select("nombre_norm").distinct().select("nombre_norm", rule.alias("_r"))
    return named.join(rules, "nombre_norm").select("doc_id", "linea", "nombre_norm", F.col("_r.code").alias("codigo_regla"), F.col("_r.conf").alias("confianza_regla"))


@query(O.over(f"select doc_id, linea, {O.ambiguous('nombre_norm', 'origen_columna')} as codigo_ambiguo from nombrado where {O.ambiguous('nombre_norm', 'origen_columna')} is not null"))
def classify_ambiguous(spark, sf_dir):
    return _named(spark, sf_dir, "doc_id", "linea", "origen_columna").select("doc_id", "linea", C.ambiguous_code(F.col("nombre_norm"), F.col("origen_columna")).alias("codigo_ambiguo")).where("codigo_ambiguo is not null")


@query(O.over("select doc_id, linea, codigo_original, nombre_original, monto, origen_columna, es_total, codigo_clasificado, metodo, round(confianza, 6) as confianza, requiere_revision, nota from resultado"))
def classify_full_cascade(spark, sf_dir):
    return _result(spark, sf_dir).drop("confianza_extraccion", "origen_columna_display").withColumn("confianza", F.round("confianza", 6))


@query(O.over(f"select doc_id, linea, {O.correction('nombre_norm', 'cod_codigo', 'origen_columna', 'monto')} as corregido from nombrado join codigos using (codigo) where origen_columna <> 'desconocido'"))
def column_correction(spark, sf_dir):
    coded = C.by_code_prefix(_named(spark, sf_dir, "doc_id", "linea", "codigo", "origen_columna", "monto")).where("cod_codigo is not null and origen_columna <> 'desconocido'")
    return coded.select("doc_id", "linea", C.column_correction(F.col("nombre_norm"), F.col("cod_codigo"), F.col("origen_columna"), F.col("monto")).alias("corregido"))


def _special(spark, sf_dir, flag: str | None = None) -> DataFrame:
    t = ledger(spark, sf_dir)
    marks = cut(t.select("nombre").distinct()).select("nombre", C.name_marks(F.col("nombre")).alias("_marks"))
    coded = C.by_code_prefix(t).withColumn("c", F.coalesce("cod_codigo", F.lit("AC.08"))).join(broadcast_if_small(marks), "nombre")
    ruled = coded.withColumn("_r", C.special_rule(F.col("_marks"), F.col("c"), F.col("monto"), F.col("giro"))).where("_r is not null")
    out = ruled.select("doc_id", "linea", "nombre", F.col("c").alias("codigo_previo"), F.col("_r.codigo_final").alias("codigo_final"), F.col("_r.flag").alias("flag"))
    return out.where(F.col("flag") == flag) if flag else out


_RULED_SQL = "ruled as (select doc_id, linea, nombre, c as codigo_previo, " + O.rules_case("nombre", "c", "monto", "giro", 1) + " as codigo_final, " + O.rules_case("nombre", "c", "monto", "giro", 2) + \
    " as flag from (select n.*, coalesce(cod_codigo, 'AC.08') as c from nombrado n left join codigos using (codigo)))"
for _i, _flag in enumerate(special.FLAGS, 1):
    QUERIES[f"special_rules_r{_i}"] = lambda spark, sf_dir, flag=_flag: _special(spark, sf_dir, flag)
    ORACLES[f"special_rules_r{_i}"] = O.over(f"select * from ruled where flag = '{_flag}'", _RULED_SQL)


@query(O.over("select * from ruled where flag is not null", _RULED_SQL))
def special_rules_all(spark, sf_dir):
    return _special(spark, sf_dir)


# --- review, propagation, dictionary ----------------------------------------------------------------------------


@query(O.over("select doc_id, linea, nombre_original, codigo_clasificado, round(confianza, 6) as confianza from resultado where (requiere_revision or codigo_clasificado = '') and not es_total"))
def review_queue(spark, sf_dir):
    return B.review_queue(_result(spark, sf_dir, *_OPEN, "es_total")).select("doc_id", "linea", "nombre_original", "codigo_clasificado", F.round("confianza", 6).alias("confianza"))


@query(O.over("select doc_id, linea, nombre_original from resultado where (requiere_revision or codigo_clasificado = '') and not es_total and codigo_clasificado = ''"))
def review_unclassified(spark, sf_dir):
    return B.review_queue(_result(spark, sf_dir, "doc_id", "linea", "nombre_original", "codigo_clasificado", "requiere_revision", "es_total")).where("codigo_clasificado = ''").select("doc_id", "linea", "nombre_original")


@query(O.over("select doc_id, count(*) filter (where (requiere_revision or codigo_clasificado = '') and not es_total) as pendientes, count(*) as total from resultado group by doc_id"))
def review_counts_by_doc(spark, sf_dir):
    return B.pending_by_document(_result(spark, sf_dir, "doc_id", "codigo_clasificado", "requiere_revision", "es_total"))


@query(O.over("""
    select count(*) as total, count(*) filter (where codigo_clasificado = '') as sin_clasificar, count(*) filter (where requiere_revision) as en_revision,
        round(avg(confianza) filter (where confianza > 0), 6) as confianza_promedio, round(100.0::double * count(*) filter (where requiere_revision) / count(*), 6) as porcentaje_revision from resultado"""))
def quality_summary(spark, sf_dir):
    return B.summary(_result(spark, sf_dir, "codigo_clasificado", "requiere_revision", "confianza"))


_LABELS_SQL = "case metodo " + " ".join(f"when '{k}' then '{v}'" for k, v in special.METHOD_LABELS.items()) + " else metodo end"


@query(O.over(f"select metodo, {_LABELS_SQL} as etiqueta, count(*) as cuentas from (select split_part(metodo, '+', 1) as metodo from resultado) group by metodo"))
def method_distribution(spark, sf_dir):
    return B.method_distribution(_result(spark, sf_dir, "metodo_base").withColumnRenamed("metodo_base", "metodo"))


@query(O.over("""
    select doc_id, linea, case when codigo_clasificado = '' and first_code is not null then first_code else codigo_clasificado end as codigo_clasificado,
        case when codigo_clasificado = '' and first_code is not null then 'propagado_automático' else metodo end as metodo,
        round(case when codigo_clasificado = '' and first_code is not null then 1.0::double else confianza end, 6) as confianza
    from (select *, first_value(nullif(codigo_clasificado, '') ignore nulls) over (partition by nombre_norm order by doc_id, linea rows between unbounded preceding and unbounded following) as first_code from resultado)"""))
def propagate_labels(spark, sf_dir):
    return H.propagate_labels(cut(_result(spark, sf_dir, *_OPEN))).select("doc_id", "linea", "codigo_clasificado", "metodo", F.round("confianza", 6).alias("confianza"))


_FIXES = [("Cuenta Puente X", "PC.08", 1), ("prestamo bancario", "PNC.01", 2), ("Cuenta  Puente x", "AC.07", 3)]


@query(O.over("""
    select doc_id, linea, case when abierto then nuevo else codigo_clasificado end as codigo_clasificado, case when abierto then 'validacion_humana_lote_propagada' else metodo end as metodo,
        round(case when abierto then 1.0::double else confianza end, 6) as confianza, case when abierto then false else requiere_revision end as requiere_revision
    from (select r.*, f.nuevo, f.nuevo is not null and (requiere_revision or codigo_clasificado = '' or confianza < 1) as abierto
        from resultado r left join (values ('cuenta puente x', 'AC.07'), ('prestamo bancario', 'PNC.01')) f(n, nuevo) on f.n = nombre_norm)"""))
def propagate_correction(spark, sf_dir):
    fixes = spark.createDataFrame(_FIXES, "nombre_original string, codigo_nuevo string, seq int")
    return H.propagate_corrections(_result(spark, sf_dir, *_OPEN), fixes).select("doc_id", "linea", "codigo_clasificado", "metodo", F.round("confianza", 6).alias("confianza"), "requiere_revision")


def _corrected(spark, sf_dir, mode: str) -> DataFrame:
    result = cut(_result(spark, sf_dir, *_OPEN))  # read twice
    chosen = F.when(F.col("linea") % 3 == 0, F.lit(H.LABELS["skip"])).when(F.col("linea") % 3 == 1, F.lit("PC.08")).otherwise(F.lit(H.LABELS["new"]))
    fixes = result.where("codigo_clasificado = ''").select("doc_id", "linea", chosen.alias("codigo_nuevo"))
    return H.apply_corrections(result, fixes, mode).select("doc_id", "linea", "codigo_clasificado", "metodo", F.round("confianza", 6).alias("confianza"), "requiere_revision")


_CHOICE_SQL = "select *, case when codigo_clasificado = '' and linea % 3 = 0 then '__EXCLUIR__' when codigo_clasificado = '' and linea % 3 = 1 then 'PC.08' end as nuevo from resultado"


@query(O.over(f"select doc_id, linea, coalesce(nuevo, codigo_clasificado) as codigo_clasificado, metodo, round(confianza, 6) as confianza, nuevo is null and requiere_revision as requiere_revision from ({_CHOICE_SQL})"))
def apply_corrections_single(spark, sf_dir):
    return _corrected(spark, sf_dir, "single")


@query(O.over(f"""
    select doc_id, linea, coalesce(nuevo, codigo_clasificado) as codigo_clasificado, case when nuevo is null then metodo else 'validacion_humana_lote' end as metodo,
        round(case when nuevo is null then confianza else 1.0::double end, 6) as confianza, nuevo is null and requiere_revision as requiere_revision from ({_CHOICE_SQL})"""))
def apply_corrections_batch(spark, sf_dir):
    return _corrected(spark, sf_dir, "batch")


_CODES = [*(code for code, _ in NAMES), "XX.99"]  # one that the catalog doesn't have
_PARTS_SQL = f"partes as (select p_name as cuenta_original, ([{', '.join(map(O.q, _CODES))}])[1 + p_size % {len(_CODES)}] as codigo_estandar, p_brand as fuente, p_partkey as seq from part)"


def _code_at(number) -> Column:
    return F.element_at(F.array(*map(F.lit, _CODES)), (number % len(_CODES) + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of the parts' names."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("cuenta_original"), _code_at(F.col("p_size")).alias("codigo_estandar"), F.col("p_brand").alias("fuente"), F.col("p_partkey").alias("seq"))


_NEW_SQL = f"nuevas as (select upper(p_name) as cuenta_original, ([{', '.join(map(O.q, _CODES))}])[1 + p_partkey % {len(_CODES)}] as codigo_estandar, p_type as fuente, 1000000 + p_partkey as seq from part where p_retailprice > 950)"


@query(O.over(f"""select clave as cuenta_normalizada, arg_max(cuenta_original, seq) as cuenta_original, arg_max(codigo_estandar, seq) as codigo_estandar, arg_max(fuente, seq) as fuente
    from (select *, {O.norm('cuenta_original')} as clave from (select * from partes union all select * from nuevas)) group by clave""", _PARTS_SQL, _NEW_SQL, base=[]))
def dictionary_upsert(spark, sf_dir):
    key = T.normalize_name(F.col("cuenta_original"))
    new = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_retailprice > 950").select(
        F.upper("p_name").alias("cuenta_original"), _code_at(F.col("p_partkey")).alias("codigo_estandar"), F.col("p_type").alias("fuente"), (F.col("p_partkey") + 1000000).alias("seq"))
    out = H.upsert(_parts(spark, sf_dir).withColumn("cuenta_normalizada", key), new.withColumn("cuenta_normalizada", key), "cuenta_normalizada")
    return out.select("cuenta_normalizada", "cuenta_original", "codigo_estandar", "fuente")


_CHOSEN = ["PC.08", H.LABELS["skip"], "AC.07", H.LABELS["new"], "", EXCLUDED]


@query(O.over(f"""select cuenta_original, codigo_estandar, fuente, seq from partes union all
    select s_name, elegido, 'validacion_humana_lote', s_suppkey from (select *, ([{', '.join(map(O.q, _CHOSEN))}])[1 + s_nationkey % 6] as elegido from supplier) where elegido in ('PC.08', 'AC.07')""", _PARTS_SQL, base=[]))
def dictionary_append(spark, sf_dir):
    chosen = F.element_at(F.array(*map(F.lit, _CHOSEN)), F.col("s_nationkey") % 6 + 1)
    fixes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("nombre_original"), chosen.alias("codigo_nuevo"), F.col("s_suppkey").alias("seq"))
    return H.append_corrections(_parts(spark, sf_dir), fixes)


@query(O.over("""
    select cuenta_original, case when coalesce(nombre_estandar, '') = '' then codigo_estandar else codigo_estandar || ' — ' || nombre_estandar end as codigo_y_nombre, fuente
    from partes left join catalogo using (codigo_estandar) where regexp_matches(cuenta_original, 'ring|client', 'i') or regexp_matches(coalesce(nombre_estandar, ''), 'ring|client', 'i') or regexp_matches(codigo_estandar, 'ring|client', 'i')""", _PARTS_SQL, base=[O.CATALOG]))
def dictionary_search(spark, sf_dir):
    return H.search_dictionary(_parts(spark, sf_dir), catalog(spark), "ring|client")


@query(O.over("select cuenta_original, codigo_estandar from partes where codigo_estandar not in (select codigo_estandar from catalogo)", _PARTS_SQL, base=[O.CATALOG]))
def fk_check(spark, sf_dir):
    return H.missing_references(_parts(spark, sf_dir), catalog(spark)).select("cuenta_original", "codigo_estandar")


@query(O.over(f"select {O.norm('cuenta_original')} as clave, count(*) as veces from partes group by 1 having count(*) > 1", _PARTS_SQL, base=[]))
def unique_check(spark, sf_dir):
    return H.repeated_keys(_parts(spark, sf_dir).select(T.normalize_name(F.col("cuenta_original")).alias("clave")), "clave")


def _entries(spark, sf_dir) -> DataFrame:
    return _parts(spark, sf_dir).groupBy("codigo_estandar").agg(F.count("*").alias("entradas"))


@query(O.over("select c.*, coalesce(entradas, 0) as entradas from catalogo c left join (select codigo_estandar, count(*) as entradas from partes group by all) using (codigo_estandar)", _PARTS_SQL, base=[O.CATALOG]))
def catalog_listing(spark, sf_dir):
    """The catalog, with the number of dictionary entries of each code."""
    listed = catalog(spark).select("codigo_estandar", "nombre_estandar", "categoria")
    return listed.join(_entries(spark, sf_dir), "codigo_estandar", "left").withColumn("entradas", F.coalesce("entradas", F.lit(0)))


@query(O.over("""select orden, opcion, coalesce(entradas, 0) as entradas from (
        select (row_number() over (order by grupo, opcion) - 1)::integer as orden, opcion from (select 1 as grupo, codigo_estandar as opcion from catalogo union all values (0, ''), (2, '➕ NUEVA CATEGORÍA'), (3, '🚫 NO INCLUIR'))
    ) left join (select codigo_estandar as opcion, count(*) as entradas from partes group by all) using (opcion)""", _PARTS_SQL, base=[O.CATALOG]))
def code_options(spark, sf_dir):
    """What a reviewer can choose, with the number of dictionary entries that have it."""
    used = _entries(spark, sf_dir).withColumnRenamed("codigo_estandar", "opcion")
    return H.code_options(catalog(spark)).join(used, "opcion", "left").select("orden", "opcion", F.coalesce("entradas", F.lit(0)).alias("entradas"))


@query("select * from part where p_partkey in (select s_suppkey * 3 from supplier where s_acctbal > 0)")
def lookup_keys(spark, sf_dir):
    """Rows of a table stored by key, for keys that another table names."""
    path = f"{shared_folder(spark)}/consulta-{uuid.uuid4().hex}"
    tables.write_lookup(spark.read.parquet(f"{sf_dir}/part.parquet"), path, "p_partkey")
    wanted = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select((F.col("s_suppkey") * 3).alias("p_partkey"))
    return tables.lookup_many(spark.read.parquet(path), wanted, "p_partkey")


_GRAMS_SQL = """gramas as (
        select texto, unnest(list_distinct(list_transform(range(1, len(texto) + 1), lambda i: (' ' || texto || ' ')[i:i + 2]))) as g from (select nombre_norm as texto from nombres where nombre_norm <> '' union select clave from conocidos where clave <> '')
    ), frecuencias as (select g, count(*) as df from gramas where texto in (select clave from conocidos) group by g
    ), pesos as (select texto, g, ln((1.0::double + (select count(*) from conocidos)) / (1.0::double + coalesce(df, 0))) + 1.0::double as w from gramas left join frecuencias using (g)
    ), normas as (select texto, sqrt(sum(w * w)) as n from pesos group by texto
    ), cosenos as (
        select a.texto as nombre_norm, b.texto as parecido, round(sum(a.w * b.w) / any_value(na.n * nb.n), 9) as coseno
        from pesos a join pesos b on a.g = b.g join normas na on na.texto = a.texto join normas nb on nb.texto = b.texto
        where a.texto in (select nombre_norm from nombres) and b.texto in (select clave from conocidos) group by all)"""
_KNOWN_SQL = f"""conocidos as (select clave, arg_min(codigo, k) as codigo from (
        select clave, arg_max(codigo_estandar, seq) as codigo, 0 as k from (select *, {O.norm('cuenta_original')} as clave from diccionario) group by clave
        union all select {O.norm('nombre_estandar')} as clave, min(codigo_estandar), 1 from catalogo group by 1) group by clave)"""


@query(O.over("""select nombre_norm, parecido, codigo, round(coseno, 6) as coseno from (
        select *, row_number() over (partition by nombre_norm order by coseno desc, parecido) as k from cosenos where coseno >= 0.5) join conocidos on clave = parecido where k = 1""",
              _KNOWN_SQL, _GRAMS_SQL, base=[LEDGER_SQL, O.CATALOG, O.DICT, O.NAMED, O.NAMES]))
def open_name_matches(spark, sf_dir):
    """The known name that each account name of the ledger is most like, by the cosine of trigrams."""
    names = _named(spark, sf_dir, "nombre").select("nombre_norm").distinct()
    return S.matches(names, S.known_names(seed_dictionary(spark), catalog(spark))).withColumn("coseno", F.round("coseno", 6))


@query(O.over("select distinct doc_id, linea from resultado where (requiere_revision or codigo_clasificado = '') and not es_total and linea % 2 = 0"))
def selection_set(spark, sf_dir):
    pending = B.review_queue(_result(spark, sf_dir, "doc_id", "linea", "codigo_clasificado", "requiere_revision", "es_total")).select("doc_id", "linea")
    pending = cut(pending)  # read three times
    return H.select_rows(pending.where("linea % 3 = 0"), pending, pending.where("linea % 2 = 1"))


_DOCS = "select s_suppkey as doc_id from supplier where s_acctbal > 0"


@query(O.over_ledger(f"select doc_id, count(*) as n from ledger where doc_id in ({_DOCS}) group by doc_id"))
def docs_semi(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc_id"))
    return H.keep_documents(ledger(spark, sf_dir), docs).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(O.over_ledger(f"select doc_id, count(*) as n from ledger where doc_id not in ({_DOCS}) group by doc_id"))
def removed_docs_anti(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc_id"))
    return H.drop_documents(ledger(spark, sf_dir), docs).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(O.over("select doc_id, linea, codigo_clasificado from resultado where starts_with(codigo_clasificado, 'ER')"))
def er_semi(spark, sf_dir):
    codes = catalog(spark).where("categoria = 'resultado'").select(F.col("codigo_estandar").alias("codigo_clasificado"))
    return _result(spark, sf_dir, "doc_id", "linea", "codigo_clasificado").join(F.broadcast(codes), "codigo_clasificado", "left_semi").select("doc_id", "linea", "codigo_clasificado")


@query(O.over_ledger("""
    select declared.doc_id, ventas_anuales, ventas_balance, round(abs(ventas_balance - ventas_anuales) / ventas_anuales * 100, 4) as desviacion_pct, coalesce(abs(ventas_balance - ventas_anuales) / ventas_anuales * 100 > 2, false) as alerta
    from declared left join (select doc_id, cast(sum(cast(coalesce(monto, 0) as decimal(20,2))) as double) as ventas_balance from clasificadas where codigo_clasificado = 'ER.01' group by doc_id) using (doc_id)""",
    *O.BASE[1:], O.CLASSIFIED, "declared as (select s_suppkey as doc_id, 1000.0::double * s_suppkey as ventas_anuales from supplier where s_suppkey > 0)"))
def sales_deviation(spark, sf_dir):
    declared = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey > 0").select(F.col("s_suppkey").alias("doc_id"), (F.lit(1000.0) * F.col("s_suppkey")).alias("ventas_anuales"))
    return B.sales_deviation(_result(spark, sf_dir, "doc_id", *_SUMS), declared)


def _with_activity(spark, sf_dir) -> DataFrame:
    return _result(spark, sf_dir, "doc_id", "linea", "giro", "codigo_clasificado", "monto", "es_total")


_WITHDRAWN_SQL = "retiros as (select doc_id, linea, coalesce(giro, '') as giro, abs(c.monto) as retiro from clasificadas c join (select doc_id, linea, giro from ledger) using (doc_id, linea) where codigo_clasificado = 'AC.06S' and c.monto is not null)"
_LIMIT = 60000.0


@query(O.over_result("select giro, count(*) as n, true as en_rango from retiros group by giro", _WITHDRAWN_SQL))
def withdrawal_quantiles(spark, sf_dir):
    """Whether each quartile that the sketches give has its rank among all withdrawals of the activity, within the stated error."""
    rows = cut(K.withdrawals(_with_activity(spark, sf_dir)))  # read twice
    found = K.quantiles(K.merged(K.sketches(rows)))  # a row for each activity
    parts = [("q1", 0.25), ("mediana", 0.5), ("q3", 0.75)]
    ranks = rows.join(found, "giro").groupBy("giro").agg(
        F.count("*").alias("n"), *[F.avg((F.col("retiro") < F.col(c)).cast("double")).alias(f"_a{c}") for c, _ in parts], *[F.avg((F.col("retiro") <= F.col(c)).cast("double")).alias(f"_b{c}") for c, _ in parts])
    near = [(F.col(f"_a{c}") <= p + K.RANK_ERROR) & (F.col(f"_b{c}") >= p - K.RANK_ERROR) for c, p in parts]
    return ranks.select("giro", "n", (near[0] & near[1] & near[2]).alias("en_rango"))


@query(O.over_result(f"select doc_id, linea, giro, retiro, {_LIMIT}::double as limite from retiros where retiro > {_LIMIT}", _WITHDRAWN_SQL))
def withdrawal_alerts(spark, sf_dir):
    rows = K.withdrawals(_with_activity(spark, sf_dir))
    return K.large_withdrawals(rows, spark.createDataFrame([(g, _LIMIT) for g in ("", "Inmobiliaria Sur", "Comercio")], "giro string, limite double"))


_NOTES_SQL = "notas(actividad, textos) as (values " + ", ".join(f"('{a}', [{', '.join(map(O.q, ts))}])" for a, ts in K.NOTES.items()) + ")"


@query(O.over_result(f"""
    select doc_id, 'ventas' as tipo, 0 as orden, format('Ventas del balance ({{:,.0f}}) se desvían de las declaradas ({{:,.0f}})', ventas_balance, ventas_anuales) as alerta
    from declared join (select doc_id, cast(sum(cast(coalesce(monto, 0) as decimal(20,2))) as double) as ventas_balance from clasificadas where codigo_clasificado = 'ER.01' group by doc_id) using (doc_id)
    where abs(ventas_balance - ventas_anuales) / ventas_anuales * 100 > 2
    union all select doc_id, 'retiro', linea, format('Retiro de socios ({{:,.0f}}) sobre el límite del giro ({{:,.0f}})', retiro, {_LIMIT}::double) from retiros where retiro > {_LIMIT}
    union all select doc_id, 'giro', cast(unnest([0, 1, 2]) as integer), unnest(textos) from (select doc_id, min(giro) as giro from ledger group by doc_id) join notas on contains(lower(giro), actividad)""",
                     _WITHDRAWN_SQL, _NOTES_SQL, "declared as (select s_suppkey as doc_id, 1000.0::double * s_suppkey as ventas_anuales from supplier where s_suppkey > 0)"))
def risk_alerts(spark, sf_dir):
    declared = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey > 0").select(F.col("s_suppkey").alias("doc_id"), (F.lit(1000.0) * F.col("s_suppkey")).alias("ventas_anuales"))
    limits = spark.createDataFrame([(g, _LIMIT) for g in ("", "Inmobiliaria Sur", "Comercio")], "giro string, limite double")
    return K.alerts(cut(_with_activity(spark, sf_dir)), declared, limits)  # read three times


# --- text, profile and parsing ----------------------------------------------------------------------------------

_SHAPES = ["%s", "(%s)", "-%s", "$ %s", "%s-", "-(%s)", "--%s", "%s"]


def _amounts(spark, sf_dir) -> DataFrame:
    """Amounts in several shapes, with the separators of both conventions."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    whole, cents = F.floor("l_extendedprice"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")
    dotted = F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))
    body = F.when(F.col("l_linenumber") % 2 == 0, F.concat(dotted, F.lit(","), cents)).otherwise(dotted)
    shaped = F.coalesce(*[F.when(F.col("l_partkey") % len(_SHAPES) == i, F.concat(F.lit(s.split("%s")[0]), body, F.lit(s.split("%s")[1]))) for i, s in enumerate(_SHAPES)])
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", shaped.alias("valor"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(".")).otherwise(F.lit(",")).alias("sep"))


_AMOUNTS_SQL = """montos as (
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case l_suppkey % 2 when 0 then '.' else ',' end as sep,
        case l_partkey % 8 """ + " ".join(f"when {i} then {O.q(s.split('%s')[0])} || cuerpo || {O.q(s.split('%s')[1])}" for i, s in enumerate(_SHAPES)) + """ end as valor
    from (select *, punteado || case when l_linenumber % 2 = 0 then ',' || lpad(cast(l_partkey % 100 as varchar), 2, '0') else '' end as cuerpo from (
        select *, cast(cast(floor(floor(l_extendedprice) / 1000) as bigint) as varchar) || '.' || lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as varchar), 3, '0') as punteado from lineitem)))"""
_PARSED_SQL = """sin as (select *, replace(trim(valor), ' ', '') as v from montos),
    abierto as (select *, starts_with(v, '(') and ends_with(v, ')') as par, case when starts_with(v, '(') and ends_with(v, ')') then v[2:-2] else v end as dentro from sin),
    firmado as (select *, starts_with(dentro, '-') as menos, case when starts_with(dentro, '-') then dentro[2:] else dentro end as d from abierto),
    leido as (select *, case when v in ('', '-') then null when v in ('0', '0.00', '0,00') then 0.0::double else
        (case when par or menos then -1 else 1 end) * try_cast(case when sep = '.' then replace(replace(d, '.', ''), ',', '.') else replace(d, ',', '') end as double) end as monto from firmado)"""


@query(O.over("select l_orderkey, l_linenumber, l_partkey, valor, monto from leido", _AMOUNTS_SQL, _PARSED_SQL, base=[]))
def parse_amount(spark, sf_dir):
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "valor", T.parse_amount(F.col("valor"), F.col("sep")).alias("monto"))


@query(f"select doc_id, md5({O.norm('text')}) as normalizado from documents")
def normalize_name(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(T.normalize_name(F.col("text"))).alias("normalizado"))


@query("select c_custkey, array_to_string(list_transform(regexp_extract_all(lower(x), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') as titulo from (select c_custkey, c_name || ' s.a. ' || c_mktsegment as x from customer)")
def title_case(spark, sf_dir):
    text = F.concat(F.col("c_name"), F.lit(" s.a. "), F.col("c_mktsegment"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.title_case(text).alias("titulo"))


@query("""
    select o_orderkey, fecha, case when len(p) = 3 then lpad(p[1], greatest(2, len(p[1]))::integer, '0') || '/' || lpad(p[2], greatest(2, len(p[2]))::integer, '0') || '/' || case when len(p[3]) = 2 then '20' || p[3] else p[3] end else trim(fecha) end as normalizada
    from (select *, string_split_regex(trim(fecha), '[/\\-.]') as p from (select o_orderkey, case o_orderkey % 4
        when 0 then day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) when 1 then ' ' || day(o_orderdate) || '-' || month(o_orderdate) || '-' || (year(o_orderdate) % 100)
        when 2 then day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) else 'sin fecha ' end as fecha from orders))""")
def normalize_date(spark, sf_dir):
    d, m, y = (f("o_orderdate").cast("string") for f in (F.day, F.month, F.year))
    k = F.col("o_orderkey") % 4
    shaped = F.when(k == 0, F.concat_ws("/", d, m, y)).when(k == 1, F.concat(F.lit(" "), F.concat_ws("-", d, m, (F.year("o_orderdate") % 100).cast("string")))).when(k == 2, F.concat_ws(".", d, m, y)).otherwise(F.lit("sin fecha "))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", shaped.alias("fecha"), T.normalize_date(shaped).alias("normalizada"))


@query("""
    select l_orderkey, l_linenumber, l_partkey, linea, case when cabeza <> '' then replace(cabeza, ',', '.') || linea[len(cabeza) + 1:] else linea end as corregida
    from (select *, trim(regexp_extract(linea, '^((?:\\d{1,2}[.,]){2,4}\\d{1,2})\\s', 1)) as cabeza from (
        select l_orderkey, l_linenumber, l_partkey, (1 + l_suppkey % 9) || ',' || lpad(cast(l_linenumber as varchar), 2, '0') || case when l_partkey % 2 = 0 then ',' else '.' end || (l_partkey % 100) || case when l_partkey % 5 = 0 then 'x' else ' ' end || 'Caja 1,5' as linea from lineitem))""")
def fix_ocr_code(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.concat((1 + F.col("l_suppkey") % 9).cast("string"), F.lit(","), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.when(F.col("l_partkey") % 2 == 0, F.lit(",")).otherwise(F.lit(".")),
                    (F.col("l_partkey") % 100).cast("string"), F.when(F.col("l_partkey") % 5 == 0, F.lit("x")).otherwise(F.lit(" ")), F.lit("Caja 1,5"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", line.alias("linea"), T.fix_ocr_code(line).alias("corregida"))


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of text rendered from the ledger: code, name and up to five amounts."""
    t = ledger(spark, sf_dir)
    whole = F.floor(F.abs(F.coalesce("monto", F.lit(0.0))))
    shown = F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))
    signed = F.when(F.col("monto") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    at = lambda o: F.when(F.col("origen_columna") == o, signed).otherwise(F.lit("0"))
    tail = F.when(F.col("linea") % 3 == 0, F.concat_ws(" ", shown, F.lit("0"), *[at(o) for o in P.COLUMNS])).when(F.col("linea") % 3 == 1, F.concat_ws(" ", signed, F.lit("-"), F.lit("-"))).otherwise(F.lit(""))
    return t.select("doc_id", "linea", F.concat_ws(" ", "codigo", "nombre", F.nullif(tail, F.lit(""))).alias("texto"))


_LINES_SQL = """cifras as (
    select *, case when monto < 0 then '(' || m || ')' else m end as s from (
        select *, cast(cast(floor(w / 1000) as bigint) as varchar) || '.' || lpad(cast(cast(w as bigint) % 1000 as varchar), 3, '0') as m from (select *, floor(abs(coalesce(monto, 0))) as w from ledger))
), lineas as (
    select doc_id, linea, concat_ws(' ', codigo, nombre, case linea % 3 when 0 then concat_ws(' ', m, '0', """ + ", ".join(f"case when origen_columna = '{o}' then s else '0' end" for o in P.COLUMNS) + """)
        when 1 then concat_ws(' ', s, '-', '-') end) as texto from cifras)"""
_FORMAT_SQL = """formatos as (
    select doc_id, case when guion = m then 'guion' when punto = m then 'punto' when compacto = m then 'compacto' else 'sin_codigo' end as formato_codigo, guion, punto, compacto, sin_codigo
    from (select *, greatest(guion, punto, compacto, sin_codigo) as m from (
        select doc_id, count(*) filter (where regexp_matches(t, '^\\d+(-\\d+){2,}$')) as guion, count(*) filter (where regexp_matches(t, '^\\d+(\\.\\d+){2,}$')) as punto, count(*) filter (where regexp_matches(t, '^\\d{6,10}$')) as compacto,
            count(*) filter (where not regexp_matches(t, '^(\\d+(-\\d+){2,}|\\d+(\\.\\d+){2,}|\\d{6,10})$')) as sin_codigo
        from (select doc_id, string_split(trim(texto), ' ')[1] as t from lineas where linea < 60) group by doc_id)))"""
_VOTES_SQL = """votos as (
    select doc_id, case when puntos >= comas then '.' else ',' end as separador_miles, puntos, comas from (
        select doc_id, count(*) filter (where v = '.') as puntos, count(*) filter (where v = ',') as comas from (
            select doc_id, case when t in ('', '0', '-') then null
                when contains(t, '.') and contains(t, ',') then case when strpos(reverse(t), '.') < strpos(reverse(t), ',') then ',' else '.' end
                when contains(t, '.') then case when list_bool_and(list_transform(string_split(t, '.')[2:], lambda x: len(x) = 3)) then '.' when len(string_split(t, '.')) = 2 and len(string_split(t, '.')[2]) in (1, 2) then null else '.' end
                when contains(t, ',') then case when list_bool_and(list_transform(string_split(t, ',')[2:], lambda x: len(x) = 3)) then ',' when len(string_split(t, ',')) = 2 and len(string_split(t, ',')[2]) in (1, 2) then null else ',' end end as v
            from (select doc_id, unnest(case when len(x) = 0 then [null] else x end) as t from (select doc_id, regexp_extract_all(texto, '(-?\\(?[\\d.,]{1,18}\\)?)') as x from lineas where linea < 80))) group by doc_id))"""


@query(O.over_ledger("select * from formatos", _LINES_SQL, _FORMAT_SQL))
def detect_code_format(spark, sf_dir):
    return R.detect_code_format(_lines(spark, sf_dir))


@query(O.over_ledger("select * from votos", _LINES_SQL, _VOTES_SQL))
def detect_thousands_sep(spark, sf_dir):
    return R.detect_thousands_separator(_lines(spark, sf_dir))


_AMOUNT_SQL = """case when v in ('', '-') then null when v in ('0', '0.00', '0,00') then 0.0::double else
    (case when starts_with(v, '(') and ends_with(v, ')') or starts_with(v, '-') then -1 else 1 end) * try_cast(case when separador_miles = '.' then
        replace(replace(regexp_replace(regexp_replace(v, '^\\((.*)\\)$', '\\1'), '^-', ''), '.', ''), ',', '.') else replace(regexp_replace(regexp_replace(v, '^\\((.*)\\)$', '\\1'), '^-', ''), ',', '') end as double) end"""
_IS_AMOUNT_SQL = "(x in ('o', 'O', '-') or regexp_matches(replace(x, '$', ''), '^-?\\(?[\\d.,]{1,18}\\)?$'))"
_IDLE_SQL = "(len({0}) > 0 and not regexp_matches(coalesce({0}[-1], ''), '\\d') and len({0}[-1]) <= 2)"
_CODE_SQL = {f: "nullif(regexp_extract(l, '" + p[: p.index(r"\s+")] + r"\s', 1), '')" for f, p in P.LINE_CODES.items()}
_ACCOUNTS_SQL = f"""partidas as (
    select *, case formato_codigo {" ".join(f"when '{f}' then {c}" for f, c in _CODE_SQL.items())} else coalesce({_CODE_SQL['punto']}, {_CODE_SQL['guion']}, {_CODE_SQL['compacto']}) end as codigo
    from (select *, trim(texto) as l from lineas join formatos using (doc_id) join votos using (doc_id)) where len(l) >= 4
), palabras as (
    select *, list_filter(string_split_regex(substr(l, coalesce(len(codigo), 0) + 1), '\\s+'), lambda x: x <> '') as w0 from partidas
), cortas as (
    select *, case when {_IDLE_SQL.format('w0')} then case when {_IDLE_SQL.format('w0[:-2]')} then w0[:-3] else w0[:-2] end else w0 end as w from palabras
), contadas as (
    select *, coalesce(nullif(list_position(list_transform(list_reverse(w), lambda x: not {_IS_AMOUNT_SQL}), true), 0) - 1, len(w)) as n from cortas
), nombradas as (
    select *, trim(array_to_string(w[1:len(w) - n], ' '), ' .-') as nombre, list_transform(w[len(w) - n + 1:], lambda x: case when x in ('o', 'O', '-') then '0' else replace(x, '$', '') end) as cifras from contadas
), valoradas as (
    select *, lower(nombre) as bajo, left(translate(codigo, '.-', ''), 1) as raiz, list_transform(cifras, lambda v: {_AMOUNT_SQL}) as vs from nombradas where len(nombre) >= 3
), ubicadas as (
    select *, list_position(list_transform(vs[-4:], lambda v: v is not null and v <> 0), true) as en, list_position(list_transform(list_reverse(vs), lambda v: v is not null and v <> 0), true) as fin from valoradas
), cuentas as (
    select doc_id, linea, codigo, nombre, case when n >= 4 then coalesce(vs[-4:][nullif(en, 0)], vs[-4]) else coalesce(list_reverse(vs)[nullif(fin, 0)], vs[-1]) end as monto,
        case when n = 0 then 'desconocido' when n >= 4 then coalesce(['activo', 'pasivo', 'perdida', 'ganancia'][nullif(en, 0)], 'activo') else coalesce(
            case raiz when '1' then 'activo' when '2' then 'pasivo' when '3' then case when {O.any_of('bajo', ('capital', 'patrimonio'))} then 'pasivo' else 'perdida' end when '4' then 'perdida' when '5' then 'ganancia' end,
            {", ".join(f"case when {O.any_of('bajo', ws)} then '{o}' end" for o, ws in special.COLUMN_WORDS.items())}, 'desconocido') end as origen_columna,
        regexp_matches(nombre, {O.q('^' + patterns.TOTAL)}, 'i') as es_total, 1.0::double as confianza_extraccion from ubicadas
)"""


@query(O.over_ledger("select * from cuentas", _LINES_SQL, _FORMAT_SQL, _VOTES_SQL, _ACCOUNTS_SQL))
def parse_lines(spark, sf_dir):
    return P.parse_lines(_lines(spark, sf_dir))


_READ_SQL = f"""ledger as (
    select *, null::varchar as giro from cuentas where not (monto is null and coalesce(codigo, '') = '') and not (coalesce(codigo, '') = '' and regexp_matches(trim(nombre), {O.q('^' + patterns.NOT_AN_ACCOUNT)}, 'i')))"""
_SPREAD_SQL = """propagado as (
    select doc_id, linea, nombre_original, monto, es_total, case when codigo_clasificado = '' and primero is not null then primero else codigo_clasificado end as codigo_clasificado
    from (select *, first_value(nullif(codigo_clasificado, '') ignore nulls) over (partition by nombre_norm order by doc_id, linea rows between unbounded preceding and unbounded following) as primero from resultado))"""
_STATEMENT_SQL = [x.replace("from ledger", "from mayor") for x in (_LINES_SQL, _FORMAT_SQL, _VOTES_SQL, _ACCOUNTS_SQL)]


@query(O.over("select codigo_clasificado, nombre_estandar, categoria, orden, monto_total, num_cuentas from balance", _SPREAD_SQL, O.CLASSIFIED.replace("from resultado", "from propagado"), O.BALANCE,
              base=[LEDGER_SQL.replace("ledger as (", "mayor as (", 1), *_STATEMENT_SQL, _READ_SQL, *O.BASE[1:]]))
def statement_from_lines(spark, sf_dir):
    """The whole path: lines, accounts, noise filter, cascade, propagation, balance.

    Accounts and labels are read twice each (distinct names and rows; first labels and rows), so both are stages in the shared
    folder, not blocks in memory.
    """
    accounts = cut(C.is_account(P.parse_lines(_lines(spark, sf_dir))).select("doc_id", "linea", "codigo", "nombre", "monto", "origen_columna", "es_total", "confianza_extraccion"))
    labelled = cut(C.classified(accounts, seed_dictionary(spark), columns=(*_OPEN, "monto", "es_total")))
    return B.balance(H.propagate_labels(labelled), catalog(spark))


@query("""select doc_id, cast(unnest(range(len(p))) as integer) as linea, md5(unnest(p)) as texto from (select doc_id, string_split(text, chr(10)) as p from documents)""")
def split_lines(spark, sf_dir):
    return P.split_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("texto", F.md5("texto"))


@query(ORACLES["split_lines"])
def document_lines_sql(spark, sf_dir):
    """The same lines by SQL: a table function in a lateral join."""
    table_functions.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql("SELECT doc_id, linea, md5(contenido) AS texto FROM {docs} d, LATERAL document_lines(d.text)", docs=docs)


@query(O.over_ledger(f"select doc_id, linea, nombre from ledger where not (monto is null and codigo is null) and not (codigo is null and regexp_matches(nombre, {O.q('^' + patterns.NOT_AN_ACCOUNT)}, 'i'))"))
def noise_filter(spark, sf_dir):
    return C.is_account(ledger(spark, sf_dir)).select("doc_id", "linea", "nombre")


@query(O.over_ledger(f"select doc_id, linea, nombre, regexp_matches(nombre, {O.q('^' + patterns.TOTAL)}, 'i') as es_total from ledger"))
def total_flag(spark, sf_dir):
    return ledger(spark, sf_dir).select("doc_id", "linea", "nombre", F.col("nombre").rlike("(?iU)^" + patterns.TOTAL).alias("es_total"))


@query(O.over_ledger("""
    select doc_id, linea, nullif(codigo, texto) as codigo, texto as nombre, case when linea % 5 = 0 then confianza_extraccion else monto end as monto
    from (select *, case when len(codigo) >= len(nombre) and len(codigo) >= coalesce(len(g), 0) then codigo when len(nombre) >= coalesce(len(g), 0) then nombre else g end as texto
        from (select *, case when linea % 2 = 0 then giro end as g from ledger))"""))
def excel_rows_parse(spark, sf_dir):
    cell = lambda kind, s=None, d=None: F.struct(F.lit(kind).alias("kind"), (s if s is not None else F.lit(None).cast("string")).alias("s"), (d if d is not None else F.lit(None).cast("double")).alias("d"))
    t = ledger(spark, sf_dir)
    cells = F.array(F.when(F.col("codigo").isNotNull(), cell("s", F.col("codigo"))), cell("s", F.col("nombre")), F.when((F.col("linea") % 2 == 0) & F.col("giro").isNotNull(), cell("s", F.col("giro"))),
                    F.when(F.col("monto").isNotNull(), cell("n", None, F.col("monto"))), F.when(F.col("linea") % 5 == 0, cell("n", None, F.col("confianza_extraccion"))))
    return P.parse_cells(t.select("doc_id", "linea", cells.alias("cells"))).select("doc_id", "linea", "codigo", "nombre", "monto")


def _headers(spark, sf_dir) -> DataFrame:
    """Header lines rendered from suppliers, labelled or not."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    tax = F.concat((10 + k % 80).cast("string"), F.lit("."), F.lpad((k * 7 % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((k * 13 % 1000).cast("string"), 3, "0"), F.lit("-"), F.when(k % 11 == 10, F.lit("K")).otherwise((k % 11).cast("string")))
    name = F.concat(F.lit("COMERCIAL "), F.upper("s_name"), F.lit(" S.A."))
    first = F.when(k % 2 == 0, F.concat(F.lit("Razon Social: "), name)).otherwise(name)
    second = F.when(k % 3 == 0, F.lit("sin identificacion")).when(k % 3 == 1, F.concat(F.lit("RUT: "), tax)).otherwise(F.concat(F.lit("Id. "), tax))
    third = F.when(k % 4 == 0, F.lit("Desde 1/1/2023 hasta 31-12-23")).when(k % 4 == 1, F.lit("Balance al 30 de junio de 2022")).when(k % 4 == 2, F.lit("Ejercicio 2021")).otherwise(F.lit("Giro: venta de repuestos"))
    return s.select(k.alias("doc_id"), F.posexplode(F.array(first, second, third)).alias("linea", "texto"))


@query("""
    with s as (select s_suppkey as k, 'COMERCIAL ' || upper(s_name) || ' S.A.' as nombre, (10 + s_suppkey % 80) || '.' || lpad(cast(s_suppkey * 7 % 1000 as varchar), 3, '0') || '.' || lpad(cast(s_suppkey * 13 % 1000 as varchar), 3, '0') || '-' ||
        case when s_suppkey % 11 = 10 then 'K' else cast(s_suppkey % 11 as varchar) end as rut from supplier),
    m as (select k as doc_id, case when k % 3 = 0 then null else rut end as rut, array_to_string(list_transform(regexp_extract_all(lower(nombre), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') as razon_social,
        case k % 4 when 0 then '01/01/2023' when 1 then '01/01/2022' when 2 then '01/01/2021' end as periodo_desde, case k % 4 when 0 then '31/12/2023' when 1 then '30/06/2022' when 2 then '31/12/2021' end as periodo_hasta,
        case when k % 4 = 3 then 'Venta De Repuestos' end as giro from s)
    select *, (case when rut is null then 0 else 1 end + 1 + case when periodo_hasta is null then 0 else 1 end)::double / 3 as confianza from m""")
def extract_metadata(spark, sf_dir):
    return M.extract_metadata(_headers(spark, sf_dir))


@query("""select user_id, json_extract_string(props, '$.page') as page, count(*) as n from events group by all""")
def event_props(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("user_id", F.get_json_object("props", "$.page").alias("page")).groupBy("user_id", "page").agg(F.count("*").alias("n"))
