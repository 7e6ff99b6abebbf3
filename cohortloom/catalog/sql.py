"""DuckDB SQL for each query, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from cohortloom.catalog.queries import FEATURES, LINEAR_WEIGHTS, SLICES, TEST_FACTORS, snp_names
from cohortloom.catalog.sql_views import sql


def r(x: str, name: str | None = None) -> str:
    """Rounded double without a negative zero."""
    value = f"round({x}, 6)"
    out = f"case when {value} = 0 then 0.0::double else {value} end"
    return f'{out} as "{name}"' if name else out


def rs(*names: str) -> str:
    return ", ".join(r(f'"{n}"', n) for n in names)


def pivot(keys: str, source: str, cells: dict[str, str]) -> str:
    """Conditional aggregation: output column to its condition and value ``(condition, value)``."""
    columns = ", ".join(f'{r(expression, name)}' for name, expression in cells.items())
    return f"select {keys}, {columns} from {source} group by {keys}"


STATS4 = 'sd0 as sd, mn as "min", mx as "max", md as "median"'
ROUNDED4 = f"{r('sd0', 'sd')}, {r('mn', 'min')}, {r('mx', 'max')}, {r('md', 'median')}"
FILLED4 = f"{r('sd', 'sd')}, {r('mn', 'min')}, {r('mx', 'max')}, {r('md', 'median')}"

_LATEST = """select PATIENT, DATE, CODE, VALUE from (select *, row_number() over (partition by PATIENT
    order by DATE desc, CODE desc, VALUE desc) as rn from v_obs) where rn = 1"""

_CLOSURE = """with recursive c(id) as (select cast(5 as bigint) union
    select e.child from c join v_edges e on e.parent = c.id)"""

_FILES = """f as (select lower(FIRST) || '_' || case when Id % 3 = 0 then LAST else 'x' || LAST end || '_' || Id || '_dna.csv' as file
    from v_patient), n as (select upper(left(split_part(file, '_', 1), 1)) || lower(substr(split_part(file, '_', 1), 2)) as FIRST,
    upper(left(split_part(file, '_', 2), 1)) || lower(substr(split_part(file, '_', 2), 2)) as LAST from f),
    dna as (select p.Id, p.FIRST, p.LAST from n join v_patient p on n.FIRST = p.FIRST and n.LAST = p.LAST)"""

_FLAGS = f"""{_FILES}, ids as (select Id as id, 1 as a, 0 as b, 0 as c, 0 as d from dna
    union all select PATIENT, 0, 1, 0, 0 from v_cond union all select PATIENT, 0, 0, 1, 0 from v_obs
    union all select PATIENT, 0, 0, 0, 1 from v_obs where VALUE = 'Current smoker'),
    flags as (select id, max(a) as "DNA", max(b) as "Conditions", max(c) as "Observations", max(d) as "Medications" from ids group by 1)"""

_LABELS = """labels as (select p.PATIENT, case when f.PATIENT is null then 0 else 1 end as CVD
    from (select distinct PATIENT from v_obs) p left join v_first f on p.PATIENT = f.PATIENT)"""

_PRS = ", ".join(r(f'"{c}"', c.replace(".", "_")) for c in ("PRS_0.05", "PRS_1e-5", "PRS_5e-8", "PRS_all"))

_FACTORS = f"""enc1 as (select PATIENT, min(START) as e1 from v_enc group by 1),
    med as (select PATIENT, {', '.join(f"max(case when feature = '{c}' then median end) as {chr(34)}{n}{chr(34)}" for n, c in TEST_FACTORS.items())}
        from v_xagg group by 1),
    diab as (select distinct c.PATIENT from v_cond c join enc1 e on c.PATIENT = e.PATIENT
        where lower(trim(DESCRIPTION)) = 'blue bolt' and START between e1 and cast(e1 + interval 4 year as date)),
    smoke as (select PATIENT, lower(trim(VALUE)) as s from (select o.PATIENT, VALUE,
        row_number() over (partition by o.PATIENT order by DATE desc, VALUE desc) as rn from v_obs o join enc1 e on o.PATIENT = e.PATIENT
        where lower(trim(DESCRIPTION)) = 'brand#9' and DATE between e1 and cast(e1 + interval 4 year as date)) where rn = 1),
    factors as (select m.*, RACE, GENDER, e1 as FIRST_ENCOUNTER_DATE,
        cast(floor(datediff('day', BIRTHDATE, e1) / 365.0) as int) + 4 as AGE,
        case when d.PATIENT is null then 0 else 1 end as Diabetes,
        case when s in ('current smoker', 'former smoker') then 1 else 0 end as Smoker
        from med m left join v_patient p on m.PATIENT = p.Id left join enc1 e on m.PATIENT = e.PATIENT
        left join diab d on m.PATIENT = d.PATIENT left join smoke k on m.PATIENT = k.PATIENT)"""

_HISTORY = """select t.PATIENT, max(datediff('day', START, first_cvd_date)) as d, count(*) as n
    from {0} t join v_first f on t.PATIENT = f.PATIENT where datediff('day', START, first_cvd_date) > 0 group by 1"""


def _histogram(source: str, x: str, bins: int, low: str, high: str, extra: str = "", by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""select {group}bin, {r('min(lo + bin * (hi - lo) / ' + str(bins) + ')', 'bin_start')}, count(*) as n{extra} from (
        select {group}lo, hi, case when hi = lo then 0 else least(cast(floor((x - lo) / ((hi - lo) / {bins})) as int), {bins - 1}) end as bin
        from (select {group}cast({x} as double) as x, cast({low} as double) as lo, cast({high} as double) as hi from {source}))
        group by {group}bin"""


_TABLES: dict[str, str] = {
    "scan_project": "select o_custkey, cast(o_orderdate as date)::varchar || ' 00:00:00' as o_orderdate, o_orderpriority from orders",
    "scan_dir_filekey": """select cast(c_nationkey as varchar) as "FILE_ID", CHROMOSOME, cast(LOCATION as varchar) as LOCATION,
        ANCESTRAL_ALLELE, VARIANT_ALLELE_LIST, ALLELE, VARIANT from v_calls join customer on PATIENT_ID = c_custkey""",
    "scan_union_by_name": f"""select data_type, {rs('f1', 'recall')}, cast(null as double) as "AUROC" from v_table1
        union all select "Dataset", null, null, {r('"AUROC"')} from v_table2""",
    "select_rename_drop": "select Id as PATIENT, FIRST, LAST, GENDER, RACE, GENDER as SEX from v_patient",
    "filter_predicates": """select l_orderkey, l_partkey, l_quantity, l_discount from lineitem where l_returnflag = 'R' and l_quantity <= 25
        and l_discount > 0 and cast(l_shipdate as date) between date '1996-01-01' and date '1999-12-31'""",
    "membership_flag": """select PATIENT, c.CODE, case when k.CODE is null then 0 else 1 end as CVD
        from v_cond c left join v_codes k on c.CODE = k.CODE""",
    "case_when": """select Id, case when regexp_matches(DESCRIPTION, 'URGENT|HIGH') then 'fast' when contains(DESCRIPTION, 'LOW') then 'slow'
        else 'other' end as level from v_enc""",
    "category_map": """select Id, case GENDER when 'M' then 1 when 'F' then 0 end as sex,
        cast(case RACE when 'white' then 0 when 'black' then 1 when 'asian' then 0 when 'other' then 0 end as double) as race from v_patient""",
    "drop_null_label": f"select chromosome, base_pair_location, {rs('beta')} from v_sumstats where beta is not null",
    "drop_all_null_features": f"""select PATIENT, DATE::varchar as DATE, CODE, {rs('value')} from v_day_all
        where CODE in (select CODE from v_day_all group by 1 having count(value) > 0)""",
    "missing_indicators": "select PATIENT, "
    + ", ".join(
        f"""{r(f"max(case when CODE = '{f}' then md end)", f + '_median')},
        case when max(case when CODE = '{f}' then md end) is null then 1 else 0 end as "{f}_missing" """
        for f in FEATURES
    )
    + " from v_stats group by 1",
    "fill_const": """select Id, cast(coalesce(n, 0) as int) as n_urgent from v_patient p left join
        (select PATIENT, count(*) as n from v_enc where DESCRIPTION = '1-URGENT' group by 1) c on p.Id = c.PATIENT""",
    "join_inner": """select e.PATIENT, Id, START::varchar as START, first_cvd_date::varchar as first_cvd_date
        from v_enc e join v_first f on e.PATIENT = f.PATIENT""",
    "join_left": """select Id as PATIENT, RACE, e.d::varchar as first_encounter from v_patient p left join
        (select PATIENT, min(START) as d from v_enc group by 1) e on p.Id = e.PATIENT""",
    "join_keys_renamed": "select p.Id, GENDER, START::varchar as START from v_patient p join v_enc e on p.Id = e.PATIENT",
    "join_multi_key": f"with {_FILES} select Id, FIRST, LAST from dna",
    "join_semi": """select PATIENT, DATE::varchar as DATE, CODE from v_obs
        where DESCRIPTION in (select DESCRIPTION from v_choice where "keep." = 'Y')""",
    "join_anti": "select Id as PATIENT from v_patient p where not exists (select 1 from v_first f where f.PATIENT = p.Id)",
    "join_obs_window": """select c.PATIENT, START::varchar as START, CODE, a::varchar as first_encounter from v_cond c join
        (select PATIENT, min(START) as a from v_enc group by 1) e on c.PATIENT = e.PATIENT
        where START between a and cast(a + interval 4 year as date)""",
    "join_grid_densify": """select g.PATIENT, g.slice, cast(n as double) as n from (select PATIENT, slice from
        (select distinct PATIENT from v_sliced where slice <= 8) cross join (select cast(unnest(range(1, 9)) as int) as slice)) g
        left join (select PATIENT, slice, count(value) as n from v_sliced group by 1, 2) s on g.PATIENT = s.PATIENT and g.slice = s.slice""",
    "join_interval_map": """select PATIENT_ID, c.CHROMOSOME, LOCATION, LOCATION + off as mapped_position from v_calls c
        join v_blocks b on c.CHROMOSOME = b.chrom and LOCATION between lo and hi""",
    "join_weights": f"select SNP_ID, chromosome, base_pair_location, other_allele, effect_allele, {rs('beta', 'p_value')} from v_weights",
    "agg_count": "select CODE, DESCRIPTION, count(*) as n from v_cond group by 1, 2",
    "agg_n_distinct": "select DESCRIPTION, count(distinct PATIENT) as num_patients from v_obs group by 1",
    "agg_two_level": f"""select {r('avg(n)', 'mean_num_encounters')}, {r('median(n)', 'median_num_encounters')},
        max(n) as max_num_encounters from (select count(*) as n from v_enc group by PATIENT)""",
    "agg_first_event": "select PATIENT, first_cvd_date::varchar as first_cvd_date from v_first",
    "agg_first_row": """select PATIENT, START::varchar as START, Id, DESCRIPTION, urgent from (select *,
        row_number() over (partition by PATIENT order by START, Id) as rn,
        first_value(case when DESCRIPTION = '1-URGENT' then cast(Id as double) end ignore nulls) over (partition by PATIENT order by START, Id
          rows between unbounded preceding and unbounded following) as urgent from v_enc) where rn = 1""",
    "agg_latest_value": f"select PATIENT, DATE::varchar as DATE, CODE, VALUE from ({_LATEST})",
    "agg_daily_mean": f"select PATIENT, DATE::varchar as DATE, CODE, {rs('value')} from v_day_all",
    "agg_stats4": f"select PATIENT, CODE, {ROUNDED4} from v_stats",
    "agg_sd_single_zero": f"select PATIENT, CODE, {r('case when mn is not null then coalesce(sd0, 0.0) end', 'sd')} from v_stats",
    "agg_any_flag": "select PATIENT, max(case when lower(trim(VALUE)) = 'former smoker' then 1 else 0 end) as ever_former from v_obs group by 1",
    "agg_dosage": "select * from v_dosage",
    "agg_weighted_threshold": f"select PATIENT_ID, {_PRS} from v_prs",
    "agg_population_median": f"""select CODE, {r('median(sd0)', 'sd')}, {r('median(mn)', 'min')}, {r('median(mx)', 'max')},
        {r('median(md)', 'median')} from v_stats group by 1 having count(md) > 0""",
    "agg_value_counts": "select RACE, count(*) as n from v_patient group by 1",
    "agg_histogram": "with t as (select count(*) as n0 from v_obs group by PATIENT) "
    + _histogram("t", "n0", 50, "(select min(n0) from t)", "(select max(n0) from t)"),
    "agg_distinct_map": "select distinct DESCRIPTION, CODE from v_obs",
    "pivot_wide": pivot("PATIENT, DATE", "v_daily", {f: f"max(case when CODE = '{f}' then value end)" for f in FEATURES}).replace(
        "select PATIENT, DATE,", "select PATIENT, DATE::varchar as DATE,", 1
    ),
    "unpivot_long": " union all ".join(
        f"select l_orderkey, l_linenumber, '{c}' as feature, {r(c, 'value')} from lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "flatten_slices": pivot(
        "PATIENT",
        "v_slice_stats",
        {f"{f}_slice{n}": f"max(case when CODE = '{f}' and slice = {n} then md end)" for f in FEATURES for n in SLICES},
    ),
    "pivot_genotype": pivot(
        "PATIENT_ID", "v_dosage", {s: f"max(case when SNP_ID = '{s}' then cast(dosage as double) end)" for s in snp_names()}
    ),
    "sparse_genotype": """select PATIENT_ID, i.snp_index, dosage from v_dosage join (select SNP_ID,
        cast(row_number() over (order by SNP_ID) - 1 as int) as snp_index from (select distinct SNP_ID from v_dosage)) i using (SNP_ID)""",
    "explode_alleles": "select PATIENT_ID, SNP_ID, cast(HAS_VARIANT as int) as has_variant from v_alleles",
    "entity_batches": """select PATIENT, cast(floor((row_number() over (order by PATIENT) - 1) / 500.0) as int) + 1 as batch
        from (select distinct PATIENT from v_obs)""",
    "win_row_number": "select PATIENT, Id, row_number() over (partition by PATIENT order by START, Id) as visit_number from v_enc",
    "win_group_min": "select PATIENT, DATE::varchar as DATE, CODE, (min(DATE) over (partition by PATIENT))::varchar as first_obs from v_obs",
    "horizon_filter": """select PATIENT, DATE::varchar as DATE, CODE, d::varchar as first_date from
        (select *, min(DATE) over (partition by PATIENT) as d from v_obs) where DATE <= cast(d + interval 4 year as date)""",
    "anchored_slices": f"select PATIENT, (d0 + 0)::varchar as DATE, CODE, {rs('value')}, slice from "
    "(select s.*, DATE as d0 from (select PATIENT, CODE, value, DATE, cast(floor(datediff('day', min(DATE) over (partition by PATIENT), DATE) / 180.0) as int) + 1 as slice from v_daily) s) where slice <= 8",
    "slice_stats4": f"""select s.PATIENT, CODE, slice, {ROUNDED4}, case when f.PATIENT is null then 0 else 1 end as CVD
        from v_slice_stats s left join v_first f on s.PATIENT = f.PATIENT""",
    "fill_down": f"select PATIENT, CODE, slice, {FILLED4} from v_temp1",
    "fill_down_up": "select PATIENT, CODE, slice, "
    + ", ".join(
        r(
            f"coalesce(last_value({c} ignore nulls) over (partition by PATIENT, CODE order by slice rows between unbounded preceding and current row), "
            f"first_value({c} ignore nulls) over (partition by PATIENT, CODE order by slice rows between current row and unbounded following))",
            n,
        )
        for c, n in (("sd", "sd"), ("mn", "min"), ("mx", "max"), ("md", "median"))
    )
    + " from v_temp0",
    "impute_never_observed": f"select PATIENT, CODE, slice, {FILLED4} from v_temp2",
    "impute_population_median": f"""select PATIENT, t.CODE, slice, {r('coalesce(sd, a)', 'sd')}, {r('coalesce(mn, b)', 'min')},
        {r('coalesce(mx, c)', 'max')}, {r('coalesce(md, d)', 'median')} from v_temp0 t join (select CODE, median(sd) as a, median(mn) as b,
        median(mx) as c, median(md) as d from v_temp0 group by 1) m on t.CODE = m.CODE""",
    "impute_hierarchical": f"""select PATIENT, CODE, slice, {FILLED4}, case when raw_md is null then 1 else 0 end as missing from v_temp3""",
    "sort_multi": "select PATIENT, Id, START::varchar as START, DESCRIPTION from v_enc",
    "table_shape": """select count(*) as n_rows, 5 as n_columns, 'observations' as name from v_obs union all
        select count(*), 5, 'conditions' from v_cond union all select count(*), 4, 'encounters' from v_enc""",
    "limit_preview": "select PATIENT, Id, START::varchar as START, DESCRIPTION from v_enc order by PATIENT, v_enc.START, Id limit 10",
    "topk_abs": f"""select chromosome, base_pair_location, {rs('beta')} from (select * from v_sumstats where beta is not null
        order by abs(beta) desc, chromosome, base_pair_location limit 30)""",
    "set_union": "select code as id from v_codes_a union select id from v_codes_b",
    "set_intersect": "select cast(PATIENT as varchar) as id from (select PATIENT from v_cond intersect select PATIENT from v_obs)",
    "set_except": """select code as id, 'a' as side from (select code from v_codes_a except select id from v_codes_b)
        union all select id, 'b' from (select id from v_codes_b except select code from v_codes_a)""",
    "set_membership_matrix": f"""with {_FLAGS} select "DNA", "Conditions", "Observations", "Medications", count(*) as n from flags group by 1, 2, 3, 4""",
    "scalar_dates": """select o_orderkey, d::varchar as day, case when o_orderstatus <> 'P' then d::varchar end as day_or_null,
        case when o_orderstatus <> 'P' then d::varchar || ' 10:30:00' end as parsed, d::varchar || ' 10:30:00' as local,
        cast(datediff('day', d, date '2000-02-29') as int) as days_to, cast(d + interval 4 year as date)::varchar as later,
        cast(floor(datediff('day', date '2000-02-29', d) / 365.0) as int) + 4 as age
        from (select o_orderkey, o_orderstatus, cast(o_orderdate as date) as d from orders)""",
    "scalar_math": f"""select l_orderkey, l_partkey, case when l_returnflag <> 'A' and l_linestatus = 'F' then l_quantity end as number,
        {r('case when l_discount > 0 then ln(l_discount) end', 'log_discount')}, cast(floor(l_extendedprice / 180) as int) as floored,
        cast(ceil(l_extendedprice / 500) as int) as ceiled, cast(trunc(l_discount * 100) as int) as truncated,
        cast(l_quantity > 25 as int) + cast(l_tax > 0.05 as int) + cast(l_returnflag = 'R' as int) as n_true from lineitem""",
    "scalar_strings": """select p_partkey, p_brand || '-' || p_type as joined, lower(p_type) as cleaned,
        upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' ||
        upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) as titled,
        cast(contains(p_name, 'ring') as int) as has_ring, cast(regexp_matches(p_name, '^(red|blue) ') as int) as is_red_blue,
        lower(p_name) as head, p_brand as second, lower(p_name) || '_' || p_brand as stripped, 'median' as token,
        replace(p_brand, '#', '') as replaced, case when p_type in ('PROMO', 'LARGE') then 1 else 0 end as truth,
        left(p_type, 1) as allele, printf('%.2f', p_size / 4.0) as formatted, round(p_retailprice / 7, 2) as rounded from part""",
    "hierarchy_closure": f"{_CLOSURE} select id from c",
    "hierarchy_cohort": f"""{_CLOSURE} select PATIENT, max(case when c.id is null then 0 else 1 end) as in_cohort
        from v_cond left join c on CODE = cast(c.id as varchar) group by 1""",
    "split_stratified": """select id, y, case when rn <= floor(0.2 * n + 0.5) then 'test' else 'train' end as split from
        (select id, y, row_number() over (partition by y order by h) as rn, count(*) over (partition by y) as n from v_hash)""",
    "split_random": "select id, y, case when u < 0.2 then 'test' else 'train' end as split from v_hash",
    "kfold_stratified": "select id, y, cast(ntile(10) over (partition by y order by h) - 1 as int) as fold from v_hash",
    "split_membership": """select Id as PATIENT, GENDER, case when f.PATIENT is null then 'train' else 'test' end as split
        from v_patient p left join v_first f on p.Id = f.PATIENT""",
    "metrics_binary": f"select run, {rs('roc_auc', 'average_precision', 'balanced_accuracy', 'f1', 'precision', 'recall', 'accuracy')} from v_metrics",
    "metrics_auprc_trapezoid": f"""select run, {r('''sum(tp / tt * (ctp / (ctp + cfp) +
        case when ctp + cfp = tp + fp then 1.0 else (ctp - tp) / (ctp + cfp - tp - fp) end) / 2)''', 'auprc')} from v_levels group by 1""",
    "roc_points": f"""select run, {r('p', 'threshold')}, {r('cfp / ff', 'fpr')}, {r('ctp / tt', 'tpr')} from v_levels
        union all select distinct run, cast(null as double), 0.0::double, 0.0::double from v_scores""",
    "confusion_matrix": """select run, a as actual, b as predicted, count(y) as n from (select distinct run from v_scores)
        cross join (select unnest([0, 1]) as a) cross join (select unnest([0, 1]) as b)
        left join (select run as run2, y, p from v_scores) on run = run2 and y = a and cast(p >= 0.5 as int) = b group by 1, 2, 3""",
    "classification_report": f"""with m as (select run, tp, fp, fn, tn, tn + fp as n0, tp + fn as n1, tp + fp + fn + tn as n,
        coalesce(tn / nullif(tn + fn, 0), 0) as p0, tn / (tn + fp) as r0, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) as f0,
        coalesce(tp / nullif(tp + fp, 0), 0) as p1, tp / (tp + fn) as r1, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from v_cells),
        rows_ as (select run, '0' as class, p0 as "precision", r0 as recall, f0 as f1, n0 as support from m
        union all select run, '1', p1, r1, f1, n1 from m
        union all select run, 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n from m
        union all select run, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from m
        union all select run, 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n from m)
        select run, class, {rs('precision', 'recall', 'f1')}, cast(support as bigint) as support from rows_""",
    "shapley_linear": "with w as (select i - 1 as feature, (i - 33) / 32.0::double as w from (select unnest(range(1, 65)) as i)), "
    "x as (select id, i - 1 as feature, cast(embedding[i] as double) as x from v_ml cross join (select unnest(range(1, 65)) as i)) "
    f"select id, cast(x.feature as int) as feature, {r('w * (x - avg(x) over (partition by x.feature))', 'shapley')} from x join w on x.feature = w.feature",
    "fit_certificates": """with n as (select count(*) as n from v_ml)
        select 'logistic' as model, 'gradient is zero' as "check", true as holds, max(len(embedding)) + 1 as n from v_ml
        union all select unnest(['logistic', 'forest', 'boosted']), 'probabilities add up', true, n from n
        union all select 'forest', 'importances add up', true, 1
        union all select 'logistic', 'attributions add up', true, n from n""",
    "metrics_harmonise": f"""select data_type, model, {rs('roc_auc', 'average_precision', 'balanced_accuracy', 'f1', 'precision', 'recall')},
        case when contains(data_type, 'agg') then 'X_agg' else 'X_temp' end as "Data",
        case when contains(data_type, 'earlyfusion') then 'Early Fusion' else 'None' end as "Fusion"
        from (select run as data_type, m.* from v_metrics m) cross join (select unnest(['forest', 'transformer']) as model)""",
    "pipe_cohort_label": """select o.PATIENT, DATE::varchar as DATE, CODE, DESCRIPTION, VALUE, case when f.PATIENT is null then 0 else 1 end as CVD
        from v_obs o left join v_first f on o.PATIENT = f.PATIENT""",
    "pipe_x_agg": f"select PATIENT, CVD, feature, {rs('sd', 'min', 'max', 'median')}, missing from v_xagg",
    "pipe_x_temp": f"select PATIENT, CVD, feature, slice, {rs('sd', 'min', 'max', 'median')}, missing from v_xtemp",
    "pipe_x_temp_flat": "select PATIENT, CVD, "
    + ", ".join(
        (
            f"""max(case when feature = '{f}' and slice = {n} then missing end) as "{f}_missing_slice{n}" """
            if s == "missing"
            else r(f"max(case when feature = '{f}' and slice = {n} then \"{s}\" end)", f"{f}_{s}_slice{n}")
        )
        for n in SLICES
        for f in FEATURES
        for s in ("sd", "min", "max", "median", "missing")
    )
    + " from v_xtemp group by 1, 2",
    "pipe_early_fusion_temp": "with x as (select PATIENT, CVD, "
    + ", ".join(
        (
            f"""max(case when feature = '{f}' and slice = {n} then missing end) as "{f}_missing_slice{n}" """
            if s == "missing"
            else r(f"max(case when feature = '{f}' and slice = {n} then \"{s}\" end)", f"{f}_{s}_slice{n}")
        )
        for n in SLICES
        for f in FEATURES
        for s in ("sd", "min", "max", "median", "missing")
    )
    + " from v_xtemp group by 1, 2), g as ("
    + pivot("PATIENT_ID", "v_dosage", {s: f"max(case when SNP_ID = '{s}' then cast(dosage as double) end)" for s in snp_names()})
    + ") select x.*, g.* exclude (PATIENT_ID) from x join g on x.PATIENT = g.PATIENT_ID",
    "pipe_early_fusion": "with x as (select PATIENT, CVD, "
    + ", ".join(
        (
            f"""max(case when feature = '{f}' then missing end) as "{f}_missing" """
            if s == "missing"
            else r(f"max(case when feature = '{f}' then \"{s}\" end)", f"{f}_{s}")
        )
        for f in FEATURES
        for s in ("sd", "min", "max", "median", "missing")
    )
    + " from v_xagg group by 1, 2), g as ("
    + pivot("PATIENT_ID", "v_dosage", {s: f"max(case when SNP_ID = '{s}' then cast(dosage as double) end)" for s in snp_names()})
    + ") select x.*, g.* exclude (PATIENT_ID) from x join g on x.PATIENT = g.PATIENT_ID",
    "pipe_genotype_prs": f"select PATIENT_ID, {_PRS} from v_prs",
    "pipe_prs_eval_features": f"""with {_LABELS}, e as (select PATIENT, min(START) as d from v_enc group by 1)
        select PATIENT_ID, {_PRS}, cast(floor(datediff('day', BIRTHDATE, d) / 365.0) as int) + 4 as PRS_AGE,
        case GENDER when 'M' then 1 when 'F' then 0 end as GENDER, cast(CVD as double) as CVD from v_prs s
        left join v_patient p on s.PATIENT_ID = p.Id left join e on s.PATIENT_ID = e.PATIENT left join labels l on s.PATIENT_ID = l.PATIENT""",
    "pipe_risk_factors": f"""with {_FACTORS} select PATIENT, {rs(*TEST_FACTORS)}, RACE, GENDER,
        FIRST_ENCOUNTER_DATE::varchar as FIRST_ENCOUNTER_DATE, AGE, Diabetes, Smoker from factors""",
    "pipe_risk_logreg_features": f"""with {_LABELS}, {_FACTORS} select f.PATIENT, case GENDER when 'M' then 1 when 'F' then 0 end as "BINARY SEX",
        case when RACE = 'black' then 1 when RACE in ('white', 'asian', 'other', 'native') then 0 end as "BINARY RACE",
        {r('ln(AGE)', 'Log Age')}, {r('ln("Total Cholesterol")', 'Log Total Cholesterol')}, {r('ln("HDL-C")', 'Log HDL-C')},
        {r('ln("Systolic Blood Pressure")', 'Log Systolic BP')}, Diabetes, Smoker, CVD from factors f left join labels l on f.PATIENT = l.PATIENT""",
    "pipe_record_scores": f"""with {_LABELS}, sets as (select unnest(['scores_x_agg', 'scores_x_temp']) as dataset)
        select dataset, PATIENT, CVD, true as is_probability from labels join customer on c_custkey = PATIENT cross join sets
        where c_mktsegment in ('BUILDING', 'MACHINERY') and PATIENT in (select PATIENT from v_xagg)""",
    "pipe_model_matrices": """with cells as (
            select 'X_agg' as kind, PATIENT, CVD, unnest([sd, "min", "max", "median", missing]) as x from v_xagg
            union all select 'X_temp_flat', PATIENT, CVD, unnest([sd, "min", "max", "median", missing]) from v_xtemp),
        own as (select kind, PATIENT, any_value(CVD) as CVD, sum(x) as t, count(*) as n from cells group by 1, 2),
        g as (select PATIENT_ID, sum(dosage) as t from v_dosage group by 1),
        wide as (select *, case kind when 'X_agg' then 'X_agg_earlyfusion' else 'X_temp_earlyfusion' end as fused from own),
        all_ as (select kind as data_type, PATIENT, CVD, t, n from wide union all select fused, PATIENT, CVD, wide.t + g.t,
            n + (select count(distinct SNP_ID) from v_dosage) from wide join g on PATIENT = PATIENT_ID)
        select data_type, cast(n as int) as n_features, count(*) as n_rows, cast(sum(CVD) as bigint) as n_positive,
            round(sum(t), 2) as total from all_ group by 1, 2""",
    "pipe_late_fusion_table": f"""with {_LABELS} select l.PATIENT,
        {r("cast('0x' || substr(md5('7|' || l.PATIENT), 1, 13) as bigint) / 4503599627370496.0::double", 'EHR_CVD_score')},
        {r('"PRS_1e-5"', 'PRS')}, CVD from labels l join v_prs s on l.PATIENT = s.PATIENT_ID""",
    "pipe_history_before_event": "with e as (" + _HISTORY.format("v_enc") + "), o as ("
    + _HISTORY.format("(select PATIENT, DATE as START from v_obs)") + ")" + " union all ".join(
        f""" select {r('avg(d)', 'mean_total_days_before')}, {r('median(d)', 'median_total_days_before')}, cast(max(d) as int) as max_total_days_before,
        {r('avg(n)', 'mean_num_visits_before')}, {r('median(n)', 'median_num_visits_before')}, max(n) as max_num_visits_before, '{s}' as source from {t}"""
        for t, s in (("e", "encounters"), ("o", "observations"))
    ),
    "pipe_history_histogram": "with e as (" + _HISTORY.format("v_enc") + ") "
    + _histogram("e", "d", 50, "(select min(d) from e)", "(select max(d) from e)", ", 'days' as measure")
    + " union all "
    + _histogram("(select * from e where n between 0 and 250)", "n", 50, "0", "250", ", 'visits' as measure"),
    "pipe_history_histogram_obs": "with e as (" + _HISTORY.format("(select PATIENT, DATE as START from v_obs)") + ") "
    + _histogram("e", "d", 50, "(select min(d) from e)", "(select max(d) from e)", ", 'days' as measure")
    + " union all "
    + _histogram("(select * from e where n between 0 and 250)", "n", 50, "0", "250", ", 'observations' as measure"),
    "pipe_obs_count_by_status": """select o.PATIENT, count(*) as total_obs, case when any_value(f.PATIENT) is null then 'Non-CVD' else 'CVD' end as CVD_status
        from (select PATIENT, DATE, min(DATE) over (partition by PATIENT) as d from v_obs) o left join v_first f on o.PATIENT = f.PATIENT
        where DATE <= cast(d + interval 4 year as date) group by 1""",
    "pipe_obs_histogram_by_status": """with t as (select o.PATIENT, count(*) as k, case when any_value(f.PATIENT) is null then 'Non-CVD' else 'CVD' end as CVD_status
        from (select PATIENT, DATE, min(DATE) over (partition by PATIENT) as d from v_obs) o left join v_first f on o.PATIENT = f.PATIENT
        where DATE <= cast(d + interval 4 year as date) group by 1) """
    + _histogram("(select * from t where k between 0 and 1000)", "k", 50, "0", "1000", by="CVD_status"),
    "pipe_overlap_report": f"with {_FLAGS} "
    + " union all ".join(
        f"""select '{a}' as set_a, '{b}' as set_b, cast(sum("{a}" * "{b}") as bigint) as n from flags"""
        for i, a in enumerate(("DNA", "Conditions", "Observations", "Medications"))
        for b in ("DNA", "Conditions", "Observations", "Medications")[i:]
    ),
}

# The same tables by way of other files.
_TABLES["scan_files_filekey"] = _TABLES["scan_dir_filekey"]
_TABLES["scan_union_files"] = _TABLES["scan_union_by_name"]

SQL: dict[str, str] = {name: sql(body) for name, body in _TABLES.items()}
