"""The same views as common table expressions for DuckDB."""

from __future__ import annotations

import re

_SITE = (
    "cast(split_part(p_brand, '#', 2) as int) as b, "
    "list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) - 1 as t"
)


def _letter(letters: str) -> str:
    return f"substr('{letters}', cast((b + t) % 4 + 1 as int), 1)"


VIEWS: dict[str, str] = {
    "v_records": "select * from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey",
    "v_cond": """select o_custkey as PATIENT, cast(l_shipdate as date) as START, cast(l_partkey as varchar) as CODE,
        p_name as DESCRIPTION, l_orderkey as ENCOUNTER from v_records""",
    "v_enc": """select o_custkey as PATIENT, o_orderkey as Id, cast(o_orderdate as date) as START,
        o_orderpriority as DESCRIPTION from orders""",
    "v_obs": """select o_custkey as PATIENT, cast(l_shipdate as date) as DATE, p_brand as CODE, lower(p_brand) as DESCRIPTION,
        case when p_brand = 'Brand#9' then case l_linenumber when 1 then 'Current smoker' when 2 then ' former smoker '
               when 3 then 'never smoker' else 'unknown' end
             when l_discount = 0.1 then 'not done' else cast(l_quantity as varchar) end as VALUE from v_records""",
    "v_choice": """select distinct lower(p_brand) as DESCRIPTION,
        case when p_brand like '%5' then 'N' else 'Y' end as "keep." from part""",
    "v_patient": """select c_custkey as Id, split_part(c_name, '#', 1) as FIRST, split_part(c_name, '#', 2) as LAST,
        date '1930-01-01' + cast((c_custkey * 37) % 20000 as int) as BIRTHDATE,
        case when c_nationkey % 2 = 0 then 'M' else 'F' end as GENDER,
        case c_mktsegment when 'AUTOMOBILE' then 'white' when 'BUILDING' then 'black' when 'FURNITURE' then 'asian'
          when 'HOUSEHOLD' then 'other' when 'MACHINERY' then 'native' end as RACE from customer""",
    "v_codes_a": "select cast(p_partkey as varchar) as code from part where p_size = 1 and p_type in ('PROMO','LARGE','SMALL')",
    "v_codes_b": "select cast(p_partkey as varchar) as id from part where p_size = 1 and p_type in ('PROMO','MEDIUM')",
    "v_site_calls": f"select o_custkey, l_returnflag, l_linestatus, {_SITE} from v_records",
    "v_calls": f"""select o_custkey as PATIENT_ID, cast(1 + (b - 1) % 22 as varchar) as CHROMOSOME,
        1000 + b * 100 + t * 10 as LOCATION, {_letter('ACGT')} as ANCESTRAL_ALLELE,
        '"' || {_letter('CGTA')} || case when t = 0 then ', ' || {_letter('GTAC')} else '' end || '"' as VARIANT_ALLELE_LIST,
        case when l_returnflag = 'R' and l_linestatus = 'F' then ' ' || {_letter('CGTA')}
             when l_returnflag <> 'A' then {_letter('ACGT')} || '>' || {_letter('CGTA')}
             else {_letter('ACGT')} end as ALLELE,
        case l_returnflag when 'R' then 'True' when 'A' then '1' else 'false' end as VARIANT from v_site_calls""",
    "v_sites": f"select b, t, sum(p_size) as s, count(*) as n from (select p_size, {_SITE} from part) group by b, t",
    "v_sumstats": f"""select cast(1 + (b - 1) % 22 as varchar) as chromosome,
        cast(1000 + b * 100 + t * 10 as varchar) || '.0' as base_pair_location, {_letter('ACGT')} as effect_allele,
        case when (b + t) % 7 = 0 then 'N' else {_letter('CGTA')} end as other_allele,
        case when (b * 6 + t) % 11 <> 0 then round((cast(s as double) / n - 25) / 100, 4) end as beta,
        cast(case n % 4 when 0 then 0.5 when 1 then 0.01 when 2 then 0.000001 else 0.000000001 end as double) as p_value
        from v_sites""",
    "v_blocks": """select cast(1 + (b - 1) % 22 as varchar) as chrom,
        1000 + b * 100 + t * 10 - 2 + case when (b + t) % 9 = 0 then 4 else 0 end as lo,
        1000 + b * 100 + t * 10 + 2 + case when (b + t) % 9 = 0 then 4 else 0 end as hi, 5000 + b as off from v_sites""",
    "v_edges": "select cast(floor(p_partkey / 2.0) as bigint) as parent, p_partkey as child from part",
    "v_scores": """select doc_id as id, quality as y, cast(((doc_id * 37) % 101) / 100.0 as double) as p,
        case when toxic = 1 then 'X_agg_earlyfusion' else 'X_temp_flat' end as run from labels""",
    "v_ml": "select vec_id as id, case when label < 3 then 1 else 0 end as y, embedding from embeddings",
    # Shared steps of the feature tables.
    "v_num": """select PATIENT, DATE, CODE, DESCRIPTION,
        case when not regexp_matches(trim(VALUE), '[dDfF]$') and lower(trim(VALUE)) <> 'nan'
             then try_cast(trim(VALUE) as double) end as v from v_obs""",
    "v_day_all": "select PATIENT, DATE, CODE, avg(v) as value from v_num group by 1, 2, 3",
    "v_day_chosen": """select PATIENT, DATE, CODE, avg(v) as value from v_num
        where DESCRIPTION in (select DESCRIPTION from v_choice where "keep." = 'Y') group by 1, 2, 3""",
    "v_daily": """select PATIENT, DATE, CODE, value from (select *, min(DATE) over (partition by PATIENT) as d0 from v_day_chosen)
        where DATE <= cast(d0 + interval 4 year as date)""",
    "v_codes": "select code as CODE from v_codes_a union select id from v_codes_b",
    "v_first": "select PATIENT, min(START) as first_cvd_date from v_cond where CODE in (select CODE from v_codes) group by 1",
    "v_stats": """select PATIENT, CODE, stddev_samp(value) as sd0, min(value) as mn, max(value) as mx, median(value) as md
        from v_daily group by 1, 2""",
    "v_grid": """select p.PATIENT, f.CODE from (select distinct PATIENT from v_daily) p
        cross join (select CODE from v_daily group by 1 having count(value) > 0) f""",
    "v_agg0": """select g.PATIENT, g.CODE, case when mn is not null then coalesce(sd0, 0.0) end as sd, mn, mx, md
        from v_grid g left join v_stats s on g.PATIENT = s.PATIENT and g.CODE = s.CODE""",
    "v_aggmed": "select CODE, median(sd) as msd, median(mn) as mmn, median(mx) as mmx, median(md) as mmd from v_agg0 group by 1",
    "v_xagg": """select a.PATIENT, case when f.PATIENT is null then 0 else 1 end as CVD, a.CODE as feature,
        coalesce(sd, msd) as sd, coalesce(mn, mmn) as "min", coalesce(mx, mmx) as "max", coalesce(md, mmd) as "median",
        case when md is null then 1 else 0 end as missing
        from v_agg0 a join v_aggmed m on a.CODE = m.CODE left join v_first f on a.PATIENT = f.PATIENT""",
    "v_sliced": """select PATIENT, CODE, value, cast(floor(datediff('day', d0, DATE) / 180.0) as int) + 1 as slice
        from (select *, min(DATE) over (partition by PATIENT) as d0 from v_daily)""",
    "v_slice_stats": """select PATIENT, CODE, slice, stddev_samp(value) as sd0, min(value) as mn, max(value) as mx, median(value) as md
        from v_sliced where slice <= 8 group by 1, 2, 3""",
    "v_temp0": """select g.PATIENT, g.CODE, n.slice, case when mn is not null then coalesce(sd0, 0.0) end as sd, mn, mx, md
        from v_grid g cross join (select cast(unnest(range(1, 9)) as int) as slice) n left join v_slice_stats s
        on g.PATIENT = s.PATIENT and g.CODE = s.CODE and n.slice = s.slice""",
    "v_temp1": """select PATIENT, CODE, slice, md as raw_md,
        last_value(sd ignore nulls) over w as sd, last_value(mn ignore nulls) over w as mn,
        last_value(mx ignore nulls) over w as mx, last_value(md ignore nulls) over w as md
        from v_temp0 window w as (partition by PATIENT, CODE order by slice rows between unbounded preceding and current row)""",
    "v_tempmed": "select CODE, median(sd) as msd, median(mn) as mmn, median(mx) as mmx, median(md) as mmd from v_temp1 group by 1",
    "v_temp2": """select t.PATIENT, t.CODE, slice, raw_md,
        case when count(sd) over g = 0 then msd else sd end as sd, case when count(mn) over g = 0 then mmn else mn end as mn,
        case when count(mx) over g = 0 then mmx else mx end as mx, case when count(md) over g = 0 then mmd else md end as md
        from v_temp1 t join v_tempmed m on t.CODE = m.CODE window g as (partition by t.PATIENT, t.CODE)""",
    "v_temp3": """select PATIENT, CODE, slice, raw_md,
        coalesce(sd, first_value(sd ignore nulls) over w) as sd, coalesce(mn, first_value(mn ignore nulls) over w) as mn,
        coalesce(mx, first_value(mx ignore nulls) over w) as mx, coalesce(md, first_value(md ignore nulls) over w) as md
        from v_temp2 window w as (partition by PATIENT, CODE order by slice rows between current row and unbounded following)""",
    "v_xtemp": """select t.PATIENT, case when f.PATIENT is null then 0 else 1 end as CVD, CODE as feature, slice,
        sd, mn as "min", mx as "max", md as "median", case when raw_md is null then 1 else 0 end as missing
        from v_temp3 t left join v_first f on t.PATIENT = f.PATIENT""",
    # Shared steps of the genotype tables.
    "v_alleles": """select *, CHROMOSOME || '_' || LOCATION || '_' || ANCESTRAL_ALLELE || '_' || VARIANT_ALLELE as SNP_ID,
        VARIANT_ALLELE = case when contains(ALLELE, '>') then split_part(ALLELE, '>', 2) else trim(ALLELE) end
          and lower(VARIANT) in ('true','1','t','yes') as HAS_VARIANT
        from (select *, trim(unnest(string_split(replace(VARIANT_ALLELE_LIST, '"', ''), ','))) as VARIANT_ALLELE from v_calls)""",
    "v_dosage": "select PATIENT_ID, SNP_ID, cast(sum(cast(HAS_VARIANT as int)) as int) as dosage from v_alleles group by 1, 2",
    "v_stats_key": """select chromosome || '_' || split_part(base_pair_location, '.', 1) || '_' || effect_allele || '_' || other_allele
        as SNP_ID, chromosome, split_part(base_pair_location, '.', 1) as base_pair_location, other_allele, effect_allele, beta, p_value
        from v_sumstats""",
    "v_weights": """select s.SNP_ID, chromosome, base_pair_location, other_allele, effect_allele, beta, p_value
        from (select distinct SNP_ID from v_dosage) s left join v_stats_key k on s.SNP_ID = k.SNP_ID""",
    "v_prs": """select PATIENT_ID,
        coalesce(sum(case when p_value <= 0.05 then dosage * beta end), 0.0) as "PRS_0.05",
        coalesce(sum(case when p_value <= 1e-5 then dosage * beta end), 0.0) as "PRS_1e-5",
        coalesce(sum(case when p_value <= 5e-8 then dosage * beta end), 0.0) as "PRS_5e-8",
        coalesce(sum(case when beta is not null then dosage * beta end), 0.0) as "PRS_all"
        from v_dosage d left join v_weights w on d.SNP_ID = w.SNP_ID group by 1""",
    # Shared steps of the metrics.
    "v_levels": """select run, p, tp, fp, sum(tp) over w as ctp, sum(fp) over w as cfp,
        sum(tp) over (partition by run) as tt, sum(fp) over (partition by run) as ff
        from (select run, p, cast(sum(y) as double) as tp, cast(sum(1 - y) as double) as fp from v_scores group by 1, 2)
        window w as (partition by run order by p desc)""",
    "v_cells": """select run, cast(count(*) filter (y = 1 and p >= 0.5) as double) as tp, cast(count(*) filter (y = 0 and p >= 0.5) as double) as fp,
        cast(count(*) filter (y = 1 and p < 0.5) as double) as fn, cast(count(*) filter (y = 0 and p < 0.5) as double) as tn
        from v_scores group by 1""",
    "v_rank": """select run, sum(fp * (ctp - tp / 2)) / max(tt * ff) as roc_auc, sum(tp / tt * ctp / (ctp + cfp)) as average_precision
        from v_levels group by 1""",
    "v_metrics": """select c.run, roc_auc, average_precision, (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(tp / nullif(tp + fp, 0), 0) as "precision",
        coalesce(tp / nullif(tp + fn, 0), 0) as recall, (tp + tn) / (tp + fp + fn + tn) as accuracy
        from v_cells c join v_rank r on c.run = r.run""",
    "v_table1": """select run as data_type, balanced_accuracy, f1, "precision", recall, roc_auc, average_precision from v_metrics""",
    "v_table2": """select run as "Dataset", roc_auc as "AUROC", average_precision as "AUPRC", balanced_accuracy as "Balanced_Accuracy",
        f1 as "F1", "precision" as "Precision", recall as "Recall" from v_metrics""",
    "v_hash": "select id, y, md5('42|' || id) as h, cast('0x' || substr(md5('42|' || id), 1, 13) as bigint) / 4503599627370496.0 as u from v_ml",
}


def sql(body: str) -> str:
    """``body`` preceded by the views it needs, in order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    # DuckDB would run a shared view once per use: the larger ones are kept.
    views = ",\n".join(f"{n} as materialized ({VIEWS[n]})" for n in order)
    recursive = "recursive " if re.match(r"\s*with recursive", body) else ""
    body = re.sub(r"^\s*with (recursive )?", "", body) if body.lstrip().startswith("with ") else body
    joiner = ",\n" if recursive or re.match(r"^\w+(\([^)]*\))? as \(", body) else "\n"
    return f"with {recursive}{views}{joiner}{body}"
