"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from collections.abc import Sequence

from checks.people import ORDERS_PEOPLE, PEOPLE
from checks.queries import searched_settings
from checks.settings import (
    CAP,
    GENERAL,
    HYBRID,
    KEPT,
    LAPLACE,
    NOISE,
    ORDERS_GENERAL,
    ORDERS_NOISE,
    ORDERS_PERTURB,
    ORDERS_SWAP,
    PERTURB,
    PROPOSALS,
    SHARE,
    SIX,
    SWAP,
    SWAP_BUCKETS,
    WEIGHT,
)
from veilframe.functions.draws import key_number
from veilframe.plans.candidates import ANCHORS, default_candidates, default_grid
from veilframe.spec import MaskingConfig, MaskSpec

ORACLE: dict[str, str] = {}
TWO52 = "4503599627370496::DOUBLE"


def r(value: str, places: int = 6) -> str:
    return f"(CASE WHEN round({value}, {places}) = 0 THEN 0::DOUBLE ELSE round({value}, {places}) END)"


def d(value: float) -> str:
    return f"{value!r}::DOUBLE"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- tables ----------------------------------------------------------------------------------


def u(tag: str) -> str:
    return f"(('0x' || substr(md5('42:{tag}:' || o_orderkey), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {TWO52}"


PEOPLE_CTE = f"""
joined AS (
  SELECT o_orderkey, o_custkey % 2 AS odd, o_totalprice, o_orderpriority, coalesce(c_mktsegment, 'none') AS segment,
         18 + floor((coalesce(c_acctbal, 0) + 1000::DOUBLE) / 11000::DOUBLE * 58::DOUBLE) AS years
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
people_p AS (
  SELECT o_orderkey AS row_id, years::INTEGER AS age, CASE WHEN odd = 0 THEN 'Female' ELSE 'Male' END AS gender,
         (o_totalprice / 8000::DOUBLE + (years - 18) * 0.8::DOUBLE + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 15::DOUBLE ELSE 0 END >= 60)::INTEGER AS income,
         o_orderpriority AS education, segment AS occupation, (years - 17) / 60::DOUBLE AS chance, {u("score")} AS s1, {u("other")} AS s2
  FROM joined),
people AS (SELECT row_id, age, gender, income, education, occupation, chance, s1, s2 FROM people_p)"""

DIRTY_CTE = """
dirty AS (
  SELECT row_id,
    CASE WHEN row_id % 47 = 0 THEN '21.5' WHEN row_id % 43 = 0 THEN '20.5' WHEN row_id % 37 = 0 THEN NULL
         WHEN row_id % 31 = 0 THEN '17' WHEN row_id % 29 = 0 THEN '95.5' WHEN row_id % 19 = 0 THEN 'abc'
         ELSE age::VARCHAR END AS age,
    CASE WHEN row_id % 17 = 0 THEN '?' ELSE gender END AS gender,
    income::VARCHAR AS income,
    CASE WHEN row_id % 23 = 0 THEN chr(9) || education || ' ' ELSE education END AS education,
    CASE WHEN row_id % 41 = 0 THEN ' ?' ELSE occupation END AS occupation
  FROM people)"""

ORDERS_CTE = """
people AS (
  SELECT o_orderkey AS row_id, o_totalprice / 1000::DOUBLE AS price_k, (o_totalprice >= 250000)::INTEGER AS big,
         o_orderstatus AS status, o_orderpriority AS priority, coalesce(c_mktsegment, 'none') AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {NUMBER}) THEN try_cast({text} AS DOUBLE) END"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


# --- XXH64 of one 64-bit number, as Python for constants and as SQL for columns ------------------

# The five primes of XXH64.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
WORD = 2**64


def hash_long(value: int, seed: int) -> int:
    def turn(x: int, by: int) -> int:
        return ((x << by) | (x >> (64 - by))) % WORD

    h = (seed + P5 + 8) % WORD ^ (turn(value * P2 % WORD, 31) * P1 % WORD)
    h = (turn(h, 27) * P1 + P4) % WORD
    h = (h ^ (h >> 33)) * P2 % WORD
    h = (h ^ (h >> 29)) * P3 % WORD
    return h ^ (h >> 32)


def number64(value: int) -> str:
    return f"{value % WORD}::UHUGEINT"


def wrap(value: str) -> str:
    return f"({value} % {WORD}::UHUGEINT)"


def mul(value: str, by: int) -> str:
    return wrap(f"({value} * {number64(by)})")


def add_number(value: str, by: int) -> str:
    return f"({value} + {number64(by)})"


def rotl(value: str, by: int) -> str:
    return f"({wrap(f'({value} * {2**by}::UHUGEINT)')} + {value} // {2 ** (64 - by)}::UHUGEINT)"


def shifted(value: str, by: int) -> str:
    return f"xor({value}, {value} // {2**by}::UHUGEINT)"


# --- masks -------------------------------------------------------------------------------------


PERMUTED = -1  # in place of a number of buckets


class Masks:
    """CTEs that mask ``people`` under the columns x (number), f (flag) and c (category)."""

    def __init__(self, spec: MaskSpec, source: str, kind: str = "sha256", missing: bool = False) -> None:
        self.spec = spec
        self.kind = kind
        self.missing = missing
        s = spec
        carried = "".join(f", {c}" for c in s.carried)
        self.parts = [
            source.strip(),
            f"base AS (SELECT row_id, ({s.flag} >= 0.5)::INTEGER AS label, {s.numeric}::DOUBLE AS o_x,"
            f" {s.category} AS o_c, {s.flag}::DOUBLE AS o_f{carried} FROM people)",
            "start0 AS (SELECT *, o_x AS x, o_c AS c, o_f AS f FROM base)",
        ]
        self.count = 0
        self.finals: list[str] = []

    def add(self, body: str) -> str:
        self.count += 1
        name = f"t{self.count}"
        self.parts.append(f"{name} AS ({body})")
        return name

    def draws(self, source: str, config: MaskingConfig, stage: str) -> str:
        if self.kind == "xxhash64":
            return self.hashed_draws(source, config, stage)
        token = self.add(f"SELECT *, sha256('42:{config.key()}:{stage}:' || row_id) AS tok FROM {source}")
        lanes = ", ".join(
            f"(('0x' || substr(tok, {1 + 13 * i}, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {TWO52} AS u{i}" for i in range(4)
        )
        return self.add(f"SELECT * EXCLUDE (tok), {lanes} FROM {token}")

    def hashed_draws(self, source: str, config: MaskingConfig, stage: str) -> str:
        """XXH64 of the row id under a constant seed per lane, in 128-bit arithmetic."""
        seeds = [hash_long(key_number(config.key()), hash_long(key_number(f"42:{stage}:{i}"), 42)) for i in range(4)]
        row = f"{mul('row_id::UHUGEINT', P2)}"
        name = self.add(f"SELECT *, {mul(rotl(row, 31), P1)} AS k FROM {source}")
        mixed = ", ".join(f"{wrap(add_number(mul(rotl(f'xor({number64(s + P5 + 8)}, k)', 27), P1), P4))} AS h{i}" for i, s in enumerate(seeds))
        name = self.add(f"SELECT * EXCLUDE (k), {mixed} FROM {name}")
        for shift, prime in ((33, P2), (29, P3), (32, None)):
            step = ", ".join(
                f"{mul(shifted(f'h{i}', shift), prime) if prime else shifted(f'h{i}', shift)} AS h{i}" for i in range(4)
            )
            name = self.add(f"SELECT * REPLACE ({step}) FROM {name}")
        lanes = ", ".join(f"((h{i} // 4096)::DOUBLE + 0.5::DOUBLE) / {TWO52} AS u{i}" for i in range(4))
        return self.add(f"SELECT * EXCLUDE (h0, h1, h2, h3), {lanes} FROM {name}")

    def replace(self, source: str, x: str = "x", f: str = "f", c: str = "c") -> str:
        return self.add(f"SELECT * EXCLUDE (u0, u1, u2, u3) REPLACE ({x} AS x, {f} AS f, {c} AS c) FROM {source}")

    def clip(self, value: str) -> str:
        return f"greatest(least({value}, {d(self.spec.upper)}), {d(self.spec.lower)})"

    def noise(self, source: str, config: MaskingConfig, category: bool) -> str:
        std = d(float(config.noise_std))
        radius = "sqrt(-2::DOUBLE * ln(u0))"
        angle = "(2::DOUBLE * pi() * u1)"
        c = f"CASE WHEN u2 < {d(config.gender_mask_probability)} THEN 'Suppressed' ELSE c END" if category else "c"
        x = self.clip(f"x + {std} * ({radius} * cos{angle})")
        return self.replace(
            self.draws(source, config, "noise"),
            f"CASE WHEN x IS NULL THEN NULL ELSE {x} END" if self.missing else x,
            f"greatest(least(f + {std} / 10::DOUBLE * ({radius} * sin{angle}), 1::DOUBLE), 0::DOUBLE)",
            c,
        )

    def swap(self, source: str, config: MaskingConfig) -> str:
        drawn = self.draws(source, config, "swap")
        ranked = self.add(
            f"SELECT *, row_number() OVER (ORDER BY u0, row_id) AS rk, round_even((count(*) OVER ()) * {d(config.swap_fraction)}, 0) AS k FROM {drawn}"
        )
        chosen = "rk <= k AND k >= 2"
        moved = self.add(
            f"SELECT * EXCLUDE (rk, k) REPLACE (coalesce(lead(x) OVER w, first_value(x) OVER w) AS x,"
            f" coalesce(lead(c) OVER w, first_value(c) OVER w) AS c) FROM {ranked} WHERE {chosen} WINDOW w AS (ORDER BY u1, row_id)"
        )
        return self.add(
            f"SELECT * EXCLUDE (u0, u1, u2, u3) FROM (SELECT * FROM {moved} UNION ALL SELECT * EXCLUDE (rk, k) FROM {ranked} WHERE NOT ({chosen}))"
        )

    def swap_permuted(self, source: str, config: MaskingConfig) -> str:
        drawn = self.draws(source, config, "swap")
        ranked = self.add(f"SELECT *, row_number() OVER (ORDER BY u0, row_id) <= round_even((count(*) OVER ()) * {d(config.swap_fraction)}, 0) AS chosen FROM {drawn}")
        placed = self.add(f"SELECT *, row_number() OVER (ORDER BY u1, row_id) AS r1, row_number() OVER (ORDER BY u2, row_id) AS r2 FROM {ranked} WHERE chosen")
        draws = "u0, u1, u2, u3, chosen"
        return self.add(
            f"SELECT t.* EXCLUDE ({draws}, r1, r2) REPLACE (g.x AS x, g.c AS c) FROM {placed} t JOIN {placed} g ON t.r1 = g.r2"
            f" UNION ALL SELECT * EXCLUDE ({draws}) FROM {ranked} WHERE NOT chosen"
        )

    def swap_in_buckets(self, source: str, config: MaskingConfig, buckets: int) -> str:
        drawn = self.draws(source, config, "swap")
        window = f"PARTITION BY floor(u1 * {buckets}) ORDER BY u1, row_id"
        share = d(config.swap_fraction)
        return self.add(
            f"SELECT * EXCLUDE (u0, u1, u2, u3) REPLACE (coalesce(lead(x) OVER w, first_value(x) OVER w) AS x,"
            f" coalesce(lead(c) OVER w, first_value(c) OVER w) AS c) FROM {drawn} WHERE u0 < {share} WINDOW w AS ({window})"
            f" UNION ALL SELECT * EXCLUDE (u0, u1, u2, u3) FROM {drawn} WHERE u0 >= {share}"
        )

    def perturb(self, source: str, config: MaskingConfig) -> str:
        s = config.perturbation_strength
        if s <= 0:
            return source
        if self.missing:
            source = self.add(f"SELECT * REPLACE (coalesce(x, (SELECT median(x) FROM {source})) AS x) FROM {source}")
        sd = f"(SELECT greatest(stddev_samp(x), 1::DOUBLE) * {d(s)} FROM {source})"
        return self.replace(
            self.draws(source, config, "feature_perturbation"),
            self.clip(f"x + {sd} * (sqrt(-2::DOUBLE * ln(u0)) * cos(2::DOUBLE * pi() * u1))"),
            f"CASE WHEN u3 < {d(min(s / 2, 0.35))} THEN 1::DOUBLE - (f >= 0.5)::INTEGER::DOUBLE ELSE f END",
            f"CASE WHEN u2 < {d(min(s, 0.65))} THEN 'Perturbed' ELSE c END",
        )

    def generalize(self, source: str, config: MaskingConfig, category: bool) -> str:
        w = config.generalization_bin
        p = max(config.gender_mask_probability, min(0.5, w / 100))
        return self.replace(
            self.draws(source, config, "generalization"),
            f"floor(x / {w}) * {w} + ({w} - 1) / 2::DOUBLE",
            "(f >= 0.5)::INTEGER::DOUBLE",
            f"CASE WHEN u2 < {d(p)} THEN 'Any' ELSE c END" if category else "c",
        )

    def laplace(self, source: str, config: MaskingConfig, epsilon: float) -> str:
        s = self.spec
        drawn = self.draws(source, config, "differential_privacy")

        def noise(lane: str, scale: float) -> str:
            return f"(-{d(scale)} * sign({lane} - 0.5::DOUBLE) * ln(1::DOUBLE - 2::DOUBLE * abs({lane} - 0.5::DOUBLE)))"

        a, b = s.category_pair
        left = f"(SELECT CASE WHEN count(DISTINCT c) = 2 THEN min(c) ELSE {quoted(a)} END FROM {source})"
        right = f"(SELECT CASE WHEN count(DISTINCT c) = 2 THEN max(c) ELSE {quoted(b)} END FROM {source})"
        flip = f"u2 > 1::DOUBLE / (1::DOUBLE + exp(-{d(epsilon)}))"
        return self.replace(
            drawn,
            self.clip(f"x + {noise('u0', (s.upper - s.lower) / epsilon)}"),
            f"greatest(least(f + {noise('u1', 1.0 / epsilon)}, 1::DOUBLE), 0::DOUBLE)",
            f"CASE WHEN {flip} AND c = {left} THEN {right} WHEN {flip} AND c = {right} THEN {left}"
            f" WHEN {flip} THEN CASE WHEN u3 < 0.5 THEN {left} ELSE {right} END ELSE c END",
        )

    def mask(self, config: MaskingConfig, config_id: int, buckets: int | None = None) -> str:
        method = config.method
        if method == "noise":
            done = self.noise("start0", config, True)
        elif method == "generalization":
            done = self.generalize("start0", config, True)
        elif method == "differential_privacy":
            done = self.laplace("start0", config, config.epsilon)
        elif method == "data_swapping":
            if buckets == PERMUTED:
                done = self.swap_permuted("start0", config)
            else:
                done = self.swap_in_buckets("start0", config, buckets) if buckets else self.swap("start0", config)
        elif method == "feature_perturbation":
            done = self.perturb("start0", config)
        else:
            done = self.perturb(self.swap(self.noise("start0", config, False), config), config)
            done = self.replace_bins(done, config)
            done = self.laplace(done, config, max(config.epsilon * config.hybrid_dp_budget_fraction, 1e-6))
        w = config.generalization_bin
        low = f"(x - ({w} - 1) / 2::DOUBLE)::BIGINT"
        labels = (
            f"{low} || '-' || ({low} + {w - 1}) AS m_x_label, CASE WHEN f >= 0.5 THEN 'High' ELSE 'Low' END AS m_f_label"
            if method == "generalization"
            else "NULL::VARCHAR AS m_x_label, NULL::VARCHAR AS m_f_label"
        )
        s = self.spec
        carried = "".join(f", {c}" for c in s.carried)
        final = self.add(
            f"SELECT {config_id} AS config_id, row_id, label, o_x, o_c, o_f{carried}, x AS m_x, c AS m_c, f AS m_f, {labels} FROM {done}"
        )
        self.finals.append(final)
        return final

    def replace_bins(self, source: str, config: MaskingConfig) -> str:
        w = config.generalization_bin
        return self.add(
            f"SELECT * REPLACE (floor(x / {w}) * {w} + ({w} - 1) / 2::DOUBLE AS x, (f >= 0.5)::INTEGER::DOUBLE AS f) FROM {source}"
        )

    def query(self, body: str, *more: str) -> str:
        union = " UNION ALL ".join(f"SELECT * FROM {name}" for name in self.finals)
        parts = [*self.parts, f"masked AS ({union})", *more] if self.finals else [*self.parts, *more]
        return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


def masked(
    configs: Sequence[MaskingConfig], spec: MaskSpec = PEOPLE, buckets: int | None = None, kind: str = "sha256"
) -> Masks:
    made = Masks(spec, PEOPLE_CTE if spec is PEOPLE else ORDERS_CTE, kind)
    for config_id, config in enumerate(configs):
        made.mask(config, config_id, buckets)
    return made


def trial(configs: Sequence[MaskingConfig], spec: MaskSpec = PEOPLE) -> Masks:
    """Masks as the measures see them: with the cheap draws."""
    return masked(configs, spec, kind="xxhash64")


def masked_rows(config: MaskingConfig, spec: MaskSpec = PEOPLE, buckets: int | None = None) -> str:
    return masked([config], spec, buckets).query(masked_select(spec))


def masked_select(s: MaskSpec) -> str:
    return (
        f"SELECT row_id, {r('m_x')} AS m_{s.numeric}, m_x_label AS m_{s.numeric}_label, m_c AS m_{s.category},"
        f" {r('m_f')} AS m_{s.flag}, m_f_label AS m_{s.flag}_label FROM masked"
    )


def people_query(body: str, *more: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in (PEOPLE_CTE, *more)) + "\n" + body


# --- preparation ---------------------------------------------------------------------------------

CLEAN = f"""
SELECT row_id, round_even(greatest(least(age, 90), 18), 0)::INTEGER AS age, {strip("gender")} AS gender,
       (income >= 0.5)::INTEGER AS income, {strip("education")} AS education, {strip("occupation")} AS occupation
FROM cells
WHERE age IS NOT NULL AND gender IS NOT NULL AND income IS NOT NULL AND education IS NOT NULL AND occupation IS NOT NULL"""


def known(text: str) -> str:
    return f"CASE WHEN {text} NOT IN ('?', 'nan', 'None') THEN {text} END"


CELLS = f"""cells AS (
  SELECT row_id, {number("age")} AS age, {known("gender")} AS gender, {number("income")} AS income,
         {known("education")} AS education, {known("occupation")} AS occupation FROM dirty)"""
ALIASED_CELLS = f"""aliased AS (SELECT *, CASE WHEN income = '1' THEN ' >50K' ELSE ' <=50K' END AS class FROM dirty),
cells AS (
  SELECT row_id, {number("age")} AS age, {known(strip("gender"))} AS gender,
         regexp_matches(class, '(?i)>50K|1|high')::INTEGER AS income,
         {known(strip("education"))} AS education, {known(strip("occupation"))} AS occupation FROM aliased)"""

ORACLE["clean_people_table"] = people_query(CLEAN, DIRTY_CTE, CELLS)
ORACLE["csv_round_trip"] = ORACLE["clean_people_table"]
ORACLE["clean_people_aliased"] = people_query(CLEAN, DIRTY_CTE, ALIASED_CELLS)
ORACLE["income_text_to_flag"] = people_query(
    "SELECT row_id, regexp_matches(class, '(?i)>50K|1|high')::INTEGER AS income FROM aliased", DIRTY_CTE, ALIASED_CELLS
)
ORACLE["missing_tokens"] = people_query(
    "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS missing_{c}"
        for c in ("age", "gender", "income", "education", "occupation")
    )
    + " FROM cells",
    DIRTY_CTE,
    CELLS,
)


def lane(text: str, i: int = 0) -> str:
    return f"(('0x' || substr(sha256({text}), {1 + 13 * i}, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {TWO52}"


PUBLIC = "row_id, age, gender, income, education, occupation"
ORACLE["cap_sample"] = people_query(
    f"SELECT {PUBLIC} FROM (SELECT *, row_number() OVER (ORDER BY {lane(chr(39) + '42:cap:cap:' + chr(39) + ' || row_id')}, row_id) AS rk FROM people) WHERE rk <= {CAP}"
)
ORACLE["share_sample"] = people_query(
    f"SELECT {PUBLIC} FROM people WHERE {lane(chr(39) + '42:cap:cap:' + chr(39) + ' || row_id')} < {SHARE}"
)
ORACLE["row_numbers"] = "SELECT (row_number() OVER ()) - 1 AS row_id, o_orderkey, o_totalprice FROM orders"
ORACLE["range_midpoints"] = masked([GENERAL]).query(
    "SELECT row_id, m_x_label AS age, (split_part(m_x_label, '-', 1)::DOUBLE + split_part(m_x_label, '-', 2)::DOUBLE) / 2 AS midpoint FROM masked"
)
ORACLE["category_codes"] = masked([GENERAL]).query(
    "SELECT row_id, m_c AS gender, (dense_rank() OVER (ORDER BY m_c) - 1)::BIGINT AS code FROM masked"
)
ORACLE["category_codes_of_names"] = "SELECT c_custkey, c_name, (dense_rank() OVER (ORDER BY c_name) - 1)::BIGINT AS code FROM customer"
ORACLE["category_codes_of_dates"] = """WITH dated AS (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders)
SELECT o_orderkey, day, (dense_rank() OVER (ORDER BY day) - 1)::BIGINT AS code FROM dated"""
ORACLE["numeric_projection"] = masked([GENERAL]).query(
    """SELECT row_id, (split_part(m_x_label, '-', 1)::DOUBLE + split_part(m_x_label, '-', 2)::DOUBLE) / 2 AS age,
       CASE lower(m_f_label) WHEN 'high' THEN 1::DOUBLE ELSE 0::DOUBLE END AS income,
       (dense_rank() OVER (ORDER BY m_c) - 1)::DOUBLE AS gender_code,
       (dense_rank() OVER (ORDER BY education) - 1)::DOUBLE AS education_code,
       (dense_rank() OVER (ORDER BY occupation) - 1)::DOUBLE AS occupation_code FROM masked"""
)
ORACLE["projection_of_mixed_flags"] = people_query(
    """SELECT row_id, age::DOUBLE AS age, CASE WHEN row_id % 2 = 0 AND income = 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS income,
       (dense_rank() OVER (ORDER BY gender) - 1)::DOUBLE AS gender_code,
       (dense_rank() OVER (ORDER BY education) - 1)::DOUBLE AS education_code,
       (dense_rank() OVER (ORDER BY occupation) - 1)::DOUBLE AS occupation_code FROM people"""
)
ORACLE["fill_missing_numbers"] = people_query(
    f"""SELECT row_id, {r("coalesce(age, (SELECT median(age) FROM cells), 39::DOUBLE)")} AS age,
       coalesce(income, (SELECT median(income) FROM cells), 0::DOUBLE) AS income FROM cells""",
    DIRTY_CTE,
    CELLS,
)
ORACLE["binary_targets"] = masked([NOISE]).query("SELECT row_id, (m_f >= 0.5)::INTEGER AS target FROM masked")
ORACLE["one_hot_counts"] = masked([GENERAL]).query(
    " UNION ALL ".join(
        f"SELECT '{name}_' || {column} AS feature, count(*)::BIGINT AS ones FROM masked GROUP BY {column}"
        for name, column in (("age", "m_x_label"), ("gender", "m_c"), ("education", "education"), ("occupation", "occupation"))
    )
)

# --- masks -----------------------------------------------------------------------------------------

for _name, _config, _spec in (
    ("mask_noise", NOISE, PEOPLE),
    ("mask_swap_exact", SWAP, PEOPLE),
    ("mask_perturb", PERTURB, PEOPLE),
    ("mask_generalize", GENERAL, PEOPLE),
    ("mask_laplace", LAPLACE, PEOPLE),
    ("mask_rr_three_valued", LAPLACE, ORDERS_PEOPLE),
    ("mask_hybrid", HYBRID, PEOPLE),
    ("mask_orders_noise", ORDERS_NOISE, ORDERS_PEOPLE),
    ("mask_orders_generalize", ORDERS_GENERAL, ORDERS_PEOPLE),
):
    ORACLE[_name] = masked_rows(_config, _spec)
ORACLE["mask_swap_permuted"] = masked_rows(SWAP, PEOPLE, PERMUTED)
ORACLE["mask_swap_bucketed"] = masked_rows(SWAP, PEOPLE, SWAP_BUCKETS)
for _name, _config in (("mask_suppress", NOISE), ("mask_randomized_response", LAPLACE)):
    ORACLE[_name] = masked([_config]).query(
        "SELECT o_c AS o_gender, m_c AS m_gender, count(*)::BIGINT AS n FROM masked GROUP BY o_c, m_c"
    )
MISSING_CTE = PEOPLE_CTE.replace(
    "people AS (SELECT row_id, age,", "people AS (SELECT row_id, CASE WHEN row_id % 3 <> 0 THEN age END AS age,"
)


def masked_missing(config: MaskingConfig) -> str:
    made = Masks(PEOPLE, MISSING_CTE, missing=True)
    made.mask(config, 0)
    return made.query(masked_select(PEOPLE))


ORACLE["mask_without_gender"] = masked([NOISE]).query(
    f"SELECT row_id, {r('m_x')} AS age, {r('m_f')} AS income, education, occupation FROM masked"
)
ORACLE["mask_perturb_missing"] = masked_missing(PERTURB)
ORACLE["mask_hybrid_missing"] = masked_missing(HYBRID)
ORACLE["mask_many_settings"] = trial(SIX).query(
    f"""SELECT config_id, count(*)::BIGINT AS n, {r("avg(m_x)")} AS mean_age, {r("avg(m_f)")} AS mean_income,
       count(*) FILTER (WHERE m_c = o_c)::BIGINT AS same_gender, count(m_x_label)::BIGINT AS binned FROM masked GROUP BY config_id"""
)
ORACLE["release_generalized"] = masked([GENERAL]).query(
    "SELECT row_id, m_x_label AS age, m_c AS gender, m_f_label AS income, education, occupation FROM masked"
)

# --- profile and drift -------------------------------------------------------------------------------


def projected(spec: MaskSpec, settings: bool = True) -> str:
    """Feature columns v1..v5 per side: o1.. and (with settings) m1.."""
    part = "PARTITION BY config_id " if settings else ""
    carried = list(spec.carried)
    cat = "o_c" if settings else spec.category
    x, f = ("o_x", "o_f") if settings else (f"{spec.numeric}::DOUBLE", f"{spec.flag}::DOUBLE")

    def code(column: str) -> str:
        return f"(dense_rank() OVER ({part}ORDER BY {column}) - 1)::DOUBLE"

    columns = [f"{x} AS o1", f"{f} AS o2", f"{code(cat)} AS o3"]
    columns += [f"{code(c)} AS o{i}" for i, c in enumerate(carried, 4)]
    if settings:
        columns += ["m_x AS m1", "m_f AS m2", f"{code('m_c')} AS m3"]
        columns += [f"{code(c)} AS m{i}" for i, c in enumerate(carried, 4)]
        return f"proj AS (SELECT config_id, row_id, o_c, m_c, {', '.join(columns)} FROM masked)"
    return f"proj AS (SELECT row_id, {', '.join(columns)} FROM people)"


def names(spec: MaskSpec) -> list[str]:
    return [spec.numeric, spec.flag, f"{spec.category}_code", *[f"{c}_code" for c in spec.carried]]


def side_moments(spec: MaskSpec) -> str:
    """Long form: config_id, feature, and moments of both sides."""
    return "mom AS (" + " UNION ALL ".join(
        f"SELECT config_id, '{name}' AS feature, count(*) AS n, avg(o{i}) AS ma, avg(m{i}) AS mb,"
        f" var_samp(o{i}) AS va, var_samp(m{i}) AS vb, stddev_pop(o{i}) AS sa, stddev_pop(m{i}) AS sb,"
        f" least(min(o{i}), min(m{i})) AS lo, greatest(max(o{i}), max(m{i})) AS hi FROM proj GROUP BY config_id"
        for i, name in enumerate(names(spec), 1)
    ) + ")"


def points(spec: MaskSpec) -> str:
    return "pts AS (" + " UNION ALL ".join(
        f"SELECT config_id, '{name}' AS feature, {side}{i} AS v, {int(side == 'o')} AS a, {int(side == 'm')} AS b FROM proj"
        for i, name in enumerate(names(spec), 1)
        for side in "om"
    ) + ")"


ERFC = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223)


def p_value(t: str) -> str:
    x = f"(abs({t}) / sqrt(2::DOUBLE))"
    s = f"(1::DOUBLE / (1::DOUBLE + 0.5::DOUBLE * {x}))"
    poly = "0.17087277::DOUBLE"
    for c in reversed(ERFC):
        poly = f"(({c!r})::DOUBLE + {s} * {poly})"
    return f"least({s} * exp(-{x} * {x} + ((-1.26551223)::DOUBLE + {s} * {poly})), 1::DOUBLE)"


MOMENT_DRIFT = f"""drift_t AS (SELECT *, coalesce((ma - mb) / nullif(sqrt(va / n + vb / n), 0), 0) AS t FROM mom),
moment_drift AS (
  SELECT config_id, feature, t AS t_statistic, {p_value("t")} AS approximate_p_value, va AS original_variance,
         vb AS masked_variance, greatest(least(1 - abs(va - vb) / greatest(abs(va), 1e-9::DOUBLE), 1), 0) AS variance_preservation,
         mb - ma AS mean_shift FROM drift_t)"""

DISTANCES = """val AS (SELECT config_id, feature, v, sum(a) AS a, sum(b) AS b FROM pts GROUP BY config_id, feature, v),
cdf AS (
  SELECT config_id, feature, v,
    (sum(a) OVER w)::DOUBLE / (sum(a) OVER (PARTITION BY config_id, feature))::DOUBLE AS fa,
    (sum(b) OVER w)::DOUBLE / (sum(b) OVER (PARTITION BY config_id, feature))::DOUBLE AS fb,
    lead(v) OVER w AS nxt
  FROM val WINDOW w AS (PARTITION BY config_id, feature ORDER BY v)),
dist AS (
  SELECT config_id, feature, max(abs(fa - fb)) AS ks_statistic,
         coalesce(sum(abs(fa - fb) * (nxt - v)), 0::DOUBLE) AS wasserstein_distance FROM cdf GROUP BY config_id, feature)"""

DIVERGENCE = """ranged AS (SELECT p.*, m.lo, m.hi, (m.hi - m.lo) / 20::DOUBLE AS step, m.n FROM pts p JOIN mom m USING (config_id, feature)),
guess AS (SELECT *, least(floor((v - lo) / (hi - lo) * 20::DOUBLE), 19)::INTEGER AS g FROM ranged WHERE lo < hi),
binned AS (
  SELECT config_id, feature, step, n, a, b,
    CASE WHEN v < g * step + lo THEN g - 1 WHEN v >= (g + 1) * step + lo AND g < 19 THEN g + 1 ELSE g END AS bin FROM guess),
grid AS (SELECT config_id, feature, n, step, bin FROM (SELECT DISTINCT config_id, feature, n, step FROM binned) CROSS JOIN generate_series(0, 19) AS g(bin)),
dens AS (
  SELECT g.config_id, g.feature, g.bin, coalesce(sum(b.a), 0)::DOUBLE / g.n / g.step + 1e-9::DOUBLE AS p,
         coalesce(sum(b.b), 0)::DOUBLE / g.n / g.step + 1e-9::DOUBLE AS q
  FROM grid g LEFT JOIN binned b USING (config_id, feature, bin) GROUP BY g.config_id, g.feature, g.bin, g.n, g.step),
scaled AS (SELECT *, p / sum(p) OVER w AS pp, q / sum(q) OVER w AS qq FROM dens WINDOW w AS (PARTITION BY config_id, feature)),
kl AS (SELECT config_id, feature, sum(pp * ln(pp / qq)) AS kl_divergence FROM scaled GROUP BY config_id, feature)"""


def drift_parts(spec: MaskSpec) -> list[str]:
    return [projected(spec), side_moments(spec), points(spec), MOMENT_DRIFT, DISTANCES, DIVERGENCE]


DRIFT_JOIN = "FROM moment_drift LEFT JOIN dist USING (config_id, feature) LEFT JOIN kl USING (config_id, feature)"
DRIFT_COLUMNS = (
    "t_statistic", "approximate_p_value", "ks_statistic", "kl_divergence", "wasserstein_distance",
    "original_variance", "masked_variance", "variance_preservation", "mean_shift",
)


def drift_sql(configs: Sequence[MaskingConfig], columns: Sequence[str], spec: MaskSpec = PEOPLE) -> str:
    shown = ", ".join(f"{r(f'coalesce({c}, 0::DOUBLE)')} AS {c}" for c in columns)
    return trial(configs, spec).query(f"SELECT config_id, feature, {shown} {DRIFT_JOIN}", *drift_parts(spec))


PROFILE = projected(PEOPLE, settings=False)
ORACLE["profile_moments"] = people_query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS feature, count(*)::BIGINT AS n, {r(f'avg(o{i})')} AS mean, {r(f'var_samp(o{i})')} AS variance FROM proj"
        for i, name in enumerate(names(PEOPLE), 1)
    ),
    PROFILE,
)
ORACLE["covariance_long"] = people_query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'covar_samp(o{i}, o{j})')} AS covariance FROM proj"
        for i, a in enumerate(names(PEOPLE), 1)
        for j, b in enumerate(names(PEOPLE), 1)
    ),
    PROFILE,
)
ORACLE["correlation_long"] = people_query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr(o{i}, o{j})')} AS correlation FROM proj"
        for i, a in enumerate(names(PEOPLE), 1)
        for j, b in enumerate(names(PEOPLE), 1)
    ),
    PROFILE,
)
ORACLE["drift_welch"] = trial([NOISE, GENERAL]).query(
    "SELECT config_id, feature, "
    + ", ".join(
        f"{r(c)} AS {c}"
        for c in ("t_statistic", "approximate_p_value", "original_variance", "masked_variance", "variance_preservation", "mean_shift")
    )
    + " FROM moment_drift",
    projected(PEOPLE),
    side_moments(PEOPLE),
    MOMENT_DRIFT,
)
ORACLE["drift_ks"] = drift_sql([NOISE, LAPLACE], ["ks_statistic"])
ORACLE["drift_kl"] = drift_sql([GENERAL, PERTURB], ["kl_divergence"])
ORACLE["drift_wasserstein"] = drift_sql([NOISE, HYBRID], ["wasserstein_distance"])
ORACLE["drift_all_measures"] = drift_sql(SIX, DRIFT_COLUMNS)
ORACLE["drift_orders"] = drift_sql([ORDERS_NOISE, ORDERS_GENERAL], DRIFT_COLUMNS, ORDERS_PEOPLE)
ORACLE["drift_orders_swap"] = drift_sql([ORDERS_SWAP], DRIFT_COLUMNS, ORDERS_PEOPLE)
ORACLE["drift_orders_perturb"] = drift_sql([ORDERS_PERTURB], DRIFT_COLUMNS, ORDERS_PEOPLE)

# --- privacy ---------------------------------------------------------------------------------------

ORACLE["equivalence_classes"] = trial([GENERAL]).query(
    "SELECT m_x_label AS m_age_label, m_c AS m_gender, m_f_label AS m_income_label, count(*)::BIGINT AS class_size FROM masked GROUP BY 1, 2, 3"
)
ORACLE["class_size_per_record"] = trial([GENERAL]).query(
    "SELECT row_id, (count(*) OVER (PARTITION BY m_x_label, m_c, m_f_label))::BIGINT AS class_size FROM masked"
)


def class_parts(columns: str = "m_x, m_c, m_f") -> list[str]:
    return [
        f"sizes AS (SELECT config_id, row_id, count(*) OVER (PARTITION BY config_id, {columns}) AS size FROM masked)",
        f"classes AS (SELECT config_id, count(*) AS size FROM masked GROUP BY config_id, {columns})",
        "summary AS (SELECT config_id, min(size)::DOUBLE AS k, avg(size)::DOUBLE AS avg_size FROM classes GROUP BY config_id)",
        "reid AS (SELECT config_id, avg(1::DOUBLE / size) AS risk FROM sizes GROUP BY config_id)",
    ]


CLASS_SELECT = f"""SELECT config_id, k AS k_anonymity, {r("avg_size")} AS average_equivalence_class_size,
  {r("risk")} AS reidentification_risk FROM summary JOIN reid USING (config_id)"""
ORACLE["k_anonymity_generalized"] = trial([GENERAL]).query(CLASS_SELECT, *class_parts())
ORACLE["k_anonymity_by_education"] = trial([GENERAL]).query(CLASS_SELECT, *class_parts("m_x, m_c, education"))

DISCLOSURE = """disclosure AS (
  SELECT config_id, (greatest(least(1 - avg(abs(o_x - m_x)) / greatest(max(o_x) - min(o_x), 1e-9), 1), 0)
    + greatest(least(1 - avg(abs(o_f - m_f)) / greatest(max(o_f) - min(o_f), 1e-9), 1), 0)
    + avg((o_c = m_c)::INTEGER)) / 3 AS dis FROM masked GROUP BY config_id)"""
PRIVACY = """priv AS (
  SELECT config_id, k, avg_size, risk, dis, greatest(least(0.65::DOUBLE * risk + 0.35::DOUBLE * dis, 1), 0) AS member,
         greatest(least(0.55::DOUBLE * dis + 0.45::DOUBLE * risk, 1), 0) AS leak
  FROM summary JOIN reid USING (config_id) JOIN disclosure USING (config_id)),
scored AS (
  SELECT *, greatest(least(0.30::DOUBLE * least(k / 10, 1) + 0.20::DOUBLE * least(avg_size / 25, 1) + 0.20::DOUBLE * (1 - risk)
    + 0.15::DOUBLE * (1 - dis) + 0.15::DOUBLE * (1 - leak), 1), 0) AS score FROM priv)"""
# Of age and education only age is both masked and an identifier.
DISCLOSURE_AGE = """disclosure AS (
  SELECT config_id, greatest(least(1 - avg(abs(o_x - m_x)) / greatest(max(o_x) - min(o_x), 1e-9), 1), 0) AS dis
  FROM masked GROUP BY config_id)"""
PRIVACY_SELECT = f"""SELECT config_id, k AS k_anonymity, {r("avg_size")} AS average_equivalence_class_size,
  {r("risk")} AS reidentification_risk, {r("dis")} AS attribute_disclosure_risk, {r("member")} AS membership_inference_risk,
  {r("leak")} AS information_leakage, {r("score")} AS privacy_score, {r("1 - score")} AS privacy_loss FROM scored"""


def privacy_parts() -> list[str]:
    return [*class_parts(), DISCLOSURE, PRIVACY]


ORACLE["disclosure_risk"] = trial(SIX).query(f"SELECT config_id, {r('dis')} AS attribute_disclosure_risk FROM disclosure", DISCLOSURE)
ORACLE["privacy_score"] = trial(SIX).query(PRIVACY_SELECT, *privacy_parts())
ORACLE["privacy_score_by_education"] = trial(SIX).query(PRIVACY_SELECT, *class_parts("m_x, education"), DISCLOSURE_AGE, PRIVACY)
ORACLE["privacy_without_identifiers"] = trial([NOISE, GENERAL]).query(
    """SELECT DISTINCT config_id, 0::DOUBLE AS k_anonymity, 0::DOUBLE AS average_equivalence_class_size, 1::DOUBLE AS reidentification_risk,
       1::DOUBLE AS attribute_disclosure_risk, 1::DOUBLE AS membership_inference_risk, 1::DOUBLE AS information_leakage,
       0::DOUBLE AS privacy_score, 1::DOUBLE AS privacy_loss FROM masked"""
)
ORACLE["sweep_privacy"] = trial(default_grid()).query(PRIVACY_SELECT, *privacy_parts())
# The grid, written out: method, noise_std, bin, epsilon, category probability, swap share, strength.
GRID_VALUES = """grid_settings(config_id, method, noise_std, generalization_bin, epsilon, gender_mask_probability, swap_fraction, perturbation_strength) AS (VALUES
  (0, 'noise', 0.5, 10, 1, 0.025, 0, 0), (1, 'noise', 3, 10, 1, 0.15, 0, 0), (2, 'noise', 8, 10, 1, 0.4, 0, 0),
  (3, 'generalization', 0, 10, 1, 0, 0, 0), (4, 'generalization', 0, 20, 1, 0, 0, 0), (5, 'generalization', 0, 30, 1, 0, 0, 0),
  (6, 'differential_privacy', 0, 10, 0.5, 0, 0, 0), (7, 'differential_privacy', 0, 10, 1, 0, 0, 0), (8, 'differential_privacy', 0, 10, 3, 0, 0, 0),
  (9, 'data_swapping', 0, 10, 1, 0, 0.05, 0), (10, 'data_swapping', 0, 10, 1, 0, 0.2, 0),
  (11, 'feature_perturbation', 0, 10, 1, 0, 0, 0.05), (12, 'feature_perturbation', 0, 10, 1, 0, 0, 0.2),
  (13, 'hybrid', 1.5, 10, 0.5, 0.075, 0.1, 0.1), (14, 'hybrid', 1.5, 10, 2, 0.075, 0.1, 0.1),
  (15, 'hybrid', 1.5, 20, 0.5, 0.075, 0.1, 0.1), (16, 'hybrid', 1.5, 20, 2, 0.075, 0.1, 0.1),
  (17, 'hybrid', 6, 10, 0.5, 0.3, 0.1, 0.1), (18, 'hybrid', 6, 10, 2, 0.3, 0.1, 0.1),
  (19, 'hybrid', 6, 20, 0.5, 0.3, 0.1, 0.1), (20, 'hybrid', 6, 20, 2, 0.3, 0.1, 0.1))"""


def parzen_draw(stage: str) -> str:
    return lane(f"'42:parzen:{stage}:' || field || ':' || proposal || ':' || draw")


def parzen_choice(name: str, field: str, values: Sequence[str], column: str, users: str, asked: str) -> list[str]:
    """The category with the best ratio among 24 draws of the good one."""
    listed = ", ".join(f"({i}, {quoted(v)})" for i, v in enumerate(values))
    return [
        f"""{name}_odds AS (
          SELECT place, value, (sum(p) OVER (ORDER BY place)) AS upto, place = {len(values) - 1} AS final, p, ln(p) - ln(q) AS ratio FROM (
            SELECT place, value, (good + 1)::DOUBLE / sum(good + 1) OVER () AS p, (bad + 1)::DOUBLE / sum(bad + 1) OVER () AS q FROM (
              SELECT v.place, v.value, count(*) FILTER (WHERE s.good) AS good, count(*) FILTER (WHERE NOT s.good) AS bad
              FROM (VALUES {listed}) AS v(place, value) LEFT JOIN (SELECT * FROM split WHERE {users}) s ON {column}::VARCHAR = v.value GROUP BY ALL)))""",
        f"{name}_tries AS (SELECT *, {parzen_draw('choice')} AS u FROM (SELECT proposal, '{field}' AS field, unnest(range(24)) AS draw FROM {asked}))",
        f"""{name}s AS (
          SELECT t.proposal, o.value FROM {name}_tries t JOIN {name}_odds o ON t.u >= o.upto - o.p AND (t.u < o.upto OR o.final)
          QUALIFY row_number() OVER (PARTITION BY t.proposal ORDER BY round(o.ratio, 9) DESC, t.draw, o.place) = 1)""",
    ]


PARZEN_FIELDS = "('noise', 'noise_std'), ('noise', 'gender_mask_probability'), ('generalization', 'gender_mask_probability'), ('differential_privacy', 'epsilon'), ('data_swapping', 'swap_fraction'), ('feature_perturbation', 'perturbation_strength'), ('hybrid', 'noise_std'), ('hybrid', 'epsilon'), ('hybrid', 'hybrid_dp_budget_fraction'), ('hybrid', 'swap_fraction'), ('hybrid', 'perturbation_strength')"
METHOD_LIST = ("noise", "generalization", "differential_privacy", "data_swapping", "feature_perturbation", "hybrid")
BELOW = "(1 / (1 + exp(-({} - k.mu) / k.scale)))"


def proposed(field: str, default: str) -> str:
    return f"{r(f'coalesce(max(c.x) FILTER (WHERE c.field = {quoted(field)}), {default})')} AS {field}"


ORACLE["parzen_proposals"] = trial(default_grid()).query(
    f"""SELECT m.proposal, m.value AS method, {proposed("noise_std", "0::DOUBLE")}, coalesce(any_value(b.value)::INTEGER, 10) AS generalization_bin,
       {proposed("epsilon", "1::DOUBLE")}, {proposed("gender_mask_probability", "0::DOUBLE")}, {proposed("hybrid_dp_budget_fraction", "0.7::DOUBLE")},
       {proposed("swap_fraction", "0::DOUBLE")}, {proposed("perturbation_strength", "0::DOUBLE")}
    FROM methods m LEFT JOIN bins b ON b.proposal = m.proposal LEFT JOIN chosen c ON c.proposal = m.proposal GROUP BY m.proposal, m.value""",
    *privacy_parts(),
    GRID_VALUES,
    f"""hist AS (SELECT g.*, 0.7 AS hybrid_dp_budget_fraction, {r("s.score")} AS objective FROM grid_settings g JOIN scored s USING (config_id)),
    split AS (SELECT *, row_number() OVER (ORDER BY objective DESC, config_id) <= least(ceil(count(*) OVER () / 10), 25) AS good FROM hist),
    asked AS (SELECT unnest(range({PROPOSALS})) AS proposal)""",
    *parzen_choice("method", "method", METHOD_LIST, "method", "true", "asked"),
    "binned AS (SELECT proposal FROM methods WHERE value IN ('generalization', 'hybrid'))",
    *parzen_choice("bin", "generalization_bin", ("5", "10", "15", "20", "25", "30"), "generalization_bin", "method IN ('generalization', 'hybrid')", "binned"),
    f"""uses(method, field) AS (VALUES {PARZEN_FIELDS}),
    spans(field, low, high) AS (VALUES ('noise_std', 0.1::DOUBLE, 12::DOUBLE), ('epsilon', ln(0.2::DOUBLE), ln(6::DOUBLE)), ('gender_mask_probability', 0::DOUBLE, 0.65::DOUBLE),
      ('swap_fraction', 0::DOUBLE, 0.45::DOUBLE), ('perturbation_strength', 0::DOUBLE, 0.45::DOUBLE), ('hybrid_dp_budget_fraction', 0.5::DOUBLE, 0.85::DOUBLE)),
    observed AS (
      SELECT p.field, p.low, p.high, s.good, s.config_id, CASE p.field WHEN 'noise_std' THEN noise_std::DOUBLE WHEN 'epsilon' THEN ln(epsilon::DOUBLE)
        WHEN 'gender_mask_probability' THEN gender_mask_probability::DOUBLE WHEN 'swap_fraction' THEN swap_fraction::DOUBLE
        WHEN 'perturbation_strength' THEN perturbation_strength::DOUBLE ELSE hybrid_dp_budget_fraction::DOUBLE END AS mu
      FROM split s JOIN uses u USING (method) JOIN spans p USING (field)),
    spaced AS (
      SELECT *, row_number() OVER w AS nth, greatest(mu - coalesce(lag(mu) OVER w, low), coalesce(lead(mu) OVER w, high) - mu) AS reach,
             count(*) OVER (PARTITION BY field, good) AS n FROM observed WINDOW w AS (PARTITION BY field, good ORDER BY mu, config_id)),
    kern AS (
      SELECT field, low, high, good, nth, mu, least(greatest(reach, (high - low) / least(100, n + 2)), high - low) * (sqrt(3) / pi()) AS scale FROM spaced
      UNION ALL SELECT field, low, high, good, 0, (low + high) / 2, (high - low) * (sqrt(3) / pi()) FROM spans, (VALUES (true), (false)) AS g(good)),
    tries AS (SELECT m.proposal, u.field, unnest(range(24)) AS draw FROM methods m JOIN uses u ON u.method = m.value),
    picked AS (
      SELECT t.*, floor({parzen_draw('kernel')} * (SELECT count(*) FROM kern k WHERE k.good AND k.field = t.field)) AS nth, {parzen_draw('value')} AS u FROM tries t),
    inside AS (
      SELECT t.proposal, t.field, t.draw, k.mu, k.scale, k.low, k.high, {BELOW.format('k.low')} + t.u * ({BELOW.format('k.high')} - {BELOW.format('k.low')}) AS q
      FROM picked t JOIN kern k ON k.good AND k.field = t.field AND k.nth = t.nth),
    drawn AS (SELECT proposal, field, draw, greatest(least(mu + scale * ln(q / (1 - q)), high), low) AS x FROM inside),
    heights AS (
      SELECT d.*, k.good, exp(-abs(d.x - k.mu) / k.scale) / (k.scale * pow(1 + exp(-abs(d.x - k.mu) / k.scale), 2)) / ({BELOW.format('k.high')} - {BELOW.format('k.low')}) AS height
      FROM drawn d JOIN kern k USING (field)),
    worth AS (
      SELECT proposal, field, draw, any_value(x) AS x, ln(avg(height) FILTER (WHERE good)) - ln(avg(height) FILTER (WHERE NOT good)) AS gain FROM heights GROUP BY ALL),
    chosen AS (
      SELECT proposal, field, CASE WHEN field = 'epsilon' THEN exp(x) ELSE x END AS x FROM worth
      QUALIFY row_number() OVER (PARTITION BY proposal, field ORDER BY round(gain, 9) DESC, draw) = 1)""",
)
ORACLE["sweep_searched_settings"] = trial(searched_settings()).query(PRIVACY_SELECT, *privacy_parts())

# --- utility ---------------------------------------------------------------------------------------


def pair_cells(kind: str) -> str:
    """Original and masked matrix cells above the diagonal, per setting."""
    cells = []
    for i in range(1, 6):
        for j in range(i + 1, 6):
            if kind == "covariance":
                old, new = f"covar_samp(o{i}, o{j})", f"covar_samp(m{i}, m{j})"
            else:
                old = f"CASE WHEN min(o{i}) < max(o{i}) AND min(o{j}) < max(o{j}) THEN corr(o{i}, o{j}) ELSE 0 END"
                new = f"CASE WHEN min(m{i}) < max(m{i}) AND min(m{j}) < max(m{j}) THEN corr(m{i}, m{j}) ELSE 0 END"
            cells.append(f"SELECT config_id, {old} AS a, {new} AS b FROM proj GROUP BY config_id")
    return " UNION ALL ".join(cells)


def preservation(kind: str) -> str:
    return (
        f"{kind}_cells AS ({pair_cells(kind)}),\n"
        f"{kind}_kept AS (SELECT config_id, greatest(least(1 - avg(abs(a - b)) / greatest(avg(abs(a)), 1e-9::DOUBLE), 1), 0)"
        f" AS {kind}_preservation FROM {kind}_cells GROUP BY config_id)"
    )


SIMILARITY = """similarity AS (
  SELECT config_id, greatest(least(avg(exp(-((abs(ma - mb) + abs(sa - sb)) / greatest(sa, 1e-9::DOUBLE)) / 2)), 1), 0) AS statistical_similarity
  FROM mom GROUP BY config_id)"""
LOSS = """loss AS (
  SELECT config_id, greatest(least((avg(abs(o1 - m1)) / greatest(max(o1) - min(o1), 1e-9) + avg(abs(o2 - m2)) / greatest(max(o2) - min(o2), 1e-9)
    + avg(abs(o3 - m3)) / greatest(max(o3) - min(o3), 1e-9) + avg(abs(o4 - m4)) / greatest(max(o4) - min(o4), 1e-9)
    + avg(abs(o5 - m5)) / greatest(max(o5) - min(o5), 1e-9) + avg((o_c <> m_c)::INTEGER)) / 8, 1), 0) AS information_loss
  FROM proj GROUP BY config_id)"""


def fidelity_parts() -> list[str]:
    return [
        projected(PEOPLE), side_moments(PEOPLE), preservation("correlation"), preservation("covariance"), SIMILARITY, LOSS,
        "fidelity AS (SELECT * FROM correlation_kept JOIN covariance_kept USING (config_id) JOIN similarity USING (config_id) JOIN loss USING (config_id))",
    ]


ORACLE["matrix_preservation"] = trial(SIX).query(
    f"SELECT config_id, {r('correlation_preservation')} AS correlation_preservation, {r('covariance_preservation')} AS covariance_preservation FROM fidelity",
    *fidelity_parts(),
)
ORACLE["statistical_similarity"] = trial(SIX).query(
    f"SELECT config_id, {r('statistical_similarity')} AS statistical_similarity FROM similarity",
    projected(PEOPLE), side_moments(PEOPLE), SIMILARITY,
)
ORACLE["information_loss"] = trial(SIX).query(
    f"SELECT config_id, {r('information_loss')} AS information_loss FROM loss", projected(PEOPLE), LOSS
)

DRIFT_MEANS = """means AS (
  SELECT config_id, avg(ks_statistic) AS mean_ks_statistic, avg(coalesce(kl_divergence, 0)) AS mean_kl_divergence,
         avg(wasserstein_distance) AS mean_wasserstein_distance, avg(variance_preservation) AS mean_variance_preservation
  FROM moment_drift LEFT JOIN dist USING (config_id, feature) LEFT JOIN kl USING (config_id, feature) GROUP BY config_id)"""
FIDELITY_COLUMNS = (
    "correlation_preservation", "covariance_preservation", "statistical_similarity", "information_loss",
    "mean_ks_statistic", "mean_kl_divergence", "mean_wasserstein_distance", "mean_variance_preservation",
)
ORACLE["sweep_fidelity"] = trial(default_grid()).query(
    "SELECT config_id, " + ", ".join(f"{r(c)} AS {c}" for c in FIDELITY_COLUMNS) + " FROM fidelity JOIN means USING (config_id)",
    *fidelity_parts(), points(PEOPLE), MOMENT_DRIFT, DISTANCES, DIVERGENCE, DRIFT_MEANS,
)

# --- models without training -------------------------------------------------------------------------

SPLIT = f"""split AS (
  SELECT *, CASE WHEN su < 0.6 THEN 'train' WHEN su < 0.8 THEN 'validation' ELSE 'test' END AS part
  FROM (SELECT *, {lane("'42:models:split:' || row_id")} AS su FROM people))"""
ORACLE["split_counts"] = people_query(
    "SELECT part, income AS label, count(*)::BIGINT AS n FROM split GROUP BY part, income", SPLIT
)
ORACLE["split_exact"] = people_query(
    """SELECT row_id, income AS label, CASE WHEN rk <= round_even(n * 0.6::DOUBLE, 0) THEN 'train'
         WHEN rk <= round_even(n * 0.8::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS part
       FROM (SELECT *, row_number() OVER (PARTITION BY income ORDER BY su, row_id) AS rk, count(*) OVER (PARTITION BY income) AS n FROM split)""",
    SPLIT,
)
ORACLE["fold_counts"] = people_query(
    f"""SELECT floor({lane("'42:models:fold:' || row_id")} * 5)::INTEGER AS fold, income AS label, count(*)::BIGINT AS n
        FROM people GROUP BY 1, 2"""
)
ORACLE["class_weights"] = people_query(
    f"""SELECT income AS label, count(*)::BIGINT AS rows,
        {r("(SELECT count(*) FROM people)::DOUBLE / ((SELECT count(DISTINCT income) FROM people) * count(*))")} AS weight
        FROM people GROUP BY income"""
)

# A 0/1 column per text value, and the age in 20 equal bins: plain two-way tables against the label.
INFORMATION = """long AS (
  SELECT row_id, income AS y, 'gender' AS source, gender AS value FROM people
  UNION ALL SELECT row_id, income, 'education', education FROM people
  UNION ALL SELECT row_id, income, 'occupation', occupation FROM people),
dummies AS (
  SELECT v.source || '_' || v.value AS feature, l.y, (l.value = v.value)::INTEGER::VARCHAR AS x
  FROM (SELECT DISTINCT source, value FROM long) v JOIN long l ON l.source = v.source
  UNION ALL SELECT 'age', income, greatest(least(floor((age - 18) / 72::DOUBLE * 20::DOUBLE), 19), 0)::INTEGER::VARCHAR FROM people),
joint AS (SELECT feature, x, y, count(*) AS n FROM dummies GROUP BY feature, x, y),
margins AS (
  SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS na FROM joint),
mi AS (SELECT feature, sum(n::DOUBLE / na * ln(n::DOUBLE * na / (nx::DOUBLE * ny))) AS mutual_information FROM margins GROUP BY feature)"""
def nearest(feature: str, label: str, value: str, source: str, k: int) -> str:
    return f"SELECT '{feature}' AS feature, {k} AS k, ({label})::VARCHAR AS y, ({value})::DOUBLE AS v FROM {source}"


# Row by row: neighbours in the order of the class, then all rows nearer than the k-th.
ORACLE["nearest_information"] = people_query(
    f"""SELECT feature, {r("greatest(any_value(p.psi) + avg(pk.psi) - avg(py.psi) - avg(pm.psi), 0)")} AS mutual_information
    FROM counted c JOIN psi p ON p.x = c.n JOIN psi pk ON pk.x = c.near JOIN psi py ON py.x = c.ny JOIN psi pm ON pm.x = c.m GROUP BY feature""",
    "base AS ("
    + " UNION ALL ".join(
        [
            nearest("o_totalprice", "o_orderstatus", "o_totalprice", "orders", 3),
            nearest("o_orderdate", "o_orderstatus", "date_diff('day', DATE '1990-01-01', o_orderdate::DATE)", "orders", 3),
            nearest("o_custkey", "o_orderstatus", "o_custkey", "orders", 3),
            nearest("age", "income", "age", "people", 5),
        ]
    )
    + ")",
    """sized AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny FROM base),
    line AS (SELECT *, row_number() OVER (PARTITION BY feature, y ORDER BY v) AS i, count(*) OVER (PARTITION BY feature) AS n,
                    least(k, ny - 1) AS near FROM sized WHERE ny > 1)""",
    "around AS (SELECT *, unnest(generate_series(-5, 5)) AS o FROM line)",
    """pairs AS (
      SELECT a.feature, a.y, a.i, a.near, row_number() OVER (PARTITION BY a.feature, a.y, a.i ORDER BY abs(a.v - b.v)) AS nth, abs(a.v - b.v) AS d
      FROM around a JOIN line b ON b.feature = a.feature AND b.y = a.y AND b.i = a.i + a.o WHERE a.o <> 0)""",
    "reach AS (SELECT l.*, p.d FROM line l JOIN pairs p ON p.feature = l.feature AND p.y = l.y AND p.i = l.i AND p.nth = l.near)",
    "here AS (SELECT feature, v, count(*) AS c FROM line GROUP BY ALL)",
    "asked AS (SELECT feature, v, d, ny, n, near, count(*) AS times FROM reach GROUP BY ALL)",
    """counted_values AS (
      SELECT a.feature, a.v, a.d, a.ny, a.n, a.near, a.times, sum(h.c) AS m FROM asked a JOIN here h ON h.feature = a.feature
        AND ((a.d > 0 AND h.v > a.v - a.d AND h.v < a.v + a.d) OR (a.d = 0 AND h.v = a.v)) GROUP BY ALL)""",
    "counted AS (SELECT *, unnest(range(times)) FROM counted_values)",
    """psi AS (
      SELECT x, -0.5772156649015329::DOUBLE + coalesce(sum(1::DOUBLE / (x - 1)) FILTER (WHERE x > 1) OVER (ORDER BY x), 0) AS psi
      FROM range(1, (SELECT max(n) + 1 FROM line)) AS t(x))""",
)
def split_of(level: str, rows: str) -> list[str]:
    """Best split of each node in ``rows`` (node, row_id, g, h)."""
    gain = "g_low * g_low / (h_low + 1) + (g - g_low) * (g - g_low) / (h - h_low + 1) - g * g / (h + 1)"
    return [
        f"""cells{level} AS (
          SELECT t.node, f.idx, f.name, f.v, sum(t.g) AS g, sum(t.h) AS h FROM {rows} t JOIN feat f USING (row_id) WHERE f.allowed GROUP BY ALL)""",
        f"""sums{level} AS (
          SELECT node, idx, name, v, sum(g) OVER w AS g_low, sum(h) OVER w AS h_low, sum(g) OVER p AS g, sum(h) OVER p AS h
          FROM cells{level} WINDOW p AS (PARTITION BY node, idx), w AS (PARTITION BY node, idx ORDER BY v))""",
        f"""best{level} AS (
          SELECT *, round({gain}, 9) AS gain FROM sums{level} WHERE h_low >= 1 AND h - h_low >= 1 AND round({gain}, 9) > 1e-6
          QUALIFY row_number() OVER (PARTITION BY node ORDER BY round({gain}, 9) DESC, idx, v) = 1)""",
    ]


def below(rows: str, level: str) -> str:
    return (
        f"(SELECT CASE WHEN f.v > b.v THEN 2 * b.node + 2 ELSE 2 * b.node + 1 END AS node, t.row_id, t.g, t.h"
        f" FROM {rows} t JOIN best{level} b USING (node) JOIN feat f ON f.row_id = t.row_id AND f.idx = b.idx)"
    )


ORACLE["boosted_first_tree"] = people_query(
    f"""SELECT node::INTEGER AS node, b.name AS feature, {r("b.v")} AS edge, {r("b.gain")} AS gain, {r("sum(t.g)")} AS gradient,
       {r("sum(t.h)")} AS curvature, {r("-0.1::DOUBLE * sum(t.g) / (sum(t.h) + 1)")} AS value
    FROM (SELECT * FROM rows0 UNION ALL SELECT * FROM rows1 UNION ALL SELECT * FROM rows2) t
    LEFT JOIN (SELECT * FROM best0 UNION ALL SELECT * FROM best1) b USING (node) GROUP BY node, b.name, b.v, b.gain""",
    """cells_of AS (
      SELECT row_id, 'age' AS name, 'age' AS col, '' AS val, age::DOUBLE AS v FROM people
      UNION ALL SELECT row_id, 'education_' || val, 'education', val, (education = val)::INTEGER::DOUBLE FROM people, (SELECT DISTINCT education AS val FROM people)
      UNION ALL SELECT row_id, 'gender_' || val, 'gender', val, (gender = val)::INTEGER::DOUBLE FROM people, (SELECT DISTINCT gender AS val FROM people)
      UNION ALL SELECT row_id, 'occupation_' || val, 'occupation', val, (occupation = val)::INTEGER::DOUBLE FROM people, (SELECT DISTINCT occupation AS val FROM people))""",
    """labelled AS (SELECT DISTINCT name, col, val FROM cells_of),
    drawn AS (
      SELECT name, row_number() OVER (ORDER BY col, val) AS idx,
             row_number() OVER (ORDER BY sha256('42:boost:columns0:' || name)) <= floor(0.85::DOUBLE * count(*) OVER ()) AS allowed FROM labelled),
    feat AS (SELECT c.row_id, c.name, c.v, d.idx, d.allowed FROM cells_of c JOIN drawn d USING (name))""",
    f"""rows0 AS (
      SELECT 0 AS node, row_id, 0.5::DOUBLE - income AS g, 0.25::DOUBLE AS h FROM people WHERE {lane(chr(39) + '42:boost:rows0:' + chr(39) + ' || row_id')} < 0.85)""",
    *split_of("0", "rows0"),
    f"rows1 AS {below('rows0', '0')}",
    *split_of("1", "rows1"),
    f"rows2 AS {below('rows1', '1')}",
)
ORACLE["mutual_information"] = people_query(
    f"SELECT feature, {r('mutual_information')} AS mutual_information FROM mi", INFORMATION
)
ORACLE["top_k_features"] = people_query(
    f"SELECT feature, {r('mutual_information')} AS mutual_information FROM (SELECT * FROM mi ORDER BY mutual_information DESC, feature LIMIT {KEPT})",
    INFORMATION,
)

SCORED = """scores AS (
  SELECT row_id, part, income AS y, age, (dense_rank() OVER (ORDER BY gender) - 1)::DOUBLE AS gender_code,
         0.7::DOUBLE * chance + 0.3::DOUBLE * s1 AS p, 0.4::DOUBLE * chance + 0.6::DOUBLE * s2 AS q FROM split),
scored AS (
  SELECT row_id, part, y, age, gender_code, 'sharp' AS model, p, (p >= 0.5)::INTEGER AS predicted FROM scores
  UNION ALL SELECT row_id, part, y, age, gender_code, 'blunt', q, (q >= 0.5)::INTEGER FROM scores),
confusion AS (
  SELECT model, part, count(*) AS n, count(*) FILTER (WHERE y = 1 AND predicted = 1)::DOUBLE AS tp,
         count(*) FILTER (WHERE y = 0 AND predicted = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND predicted = 0)::DOUBLE AS fn,
         count(*) FILTER (WHERE y = predicted)::DOUBLE AS good,
         avg(-(y * ln(pc) + (1 - y) * ln(1::DOUBLE - pc))) AS log_loss,
         sqrt(avg(power(y - predicted, 2))) AS rmse
  FROM (SELECT *, least(greatest(p, 1e-6::DOUBLE), 1::DOUBLE - 1e-6::DOUBLE) AS pc FROM scored) GROUP BY model, part),
quality AS (
  SELECT model, part, n, good / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, rmse, log_loss FROM confusion),
ranks AS (
  SELECT model, part, y, rank() OVER (PARTITION BY model, part ORDER BY p) + (count(*) OVER (PARTITION BY model, part, p) - 1) / 2::DOUBLE AS rk FROM scored),
auc AS (
  SELECT model, part, (sum(rk) FILTER (WHERE y = 1) - (count(*) FILTER (WHERE y = 1))::DOUBLE * (count(*) FILTER (WHERE y = 1) + 1) / 2)
    / ((count(*) FILTER (WHERE y = 1))::DOUBLE * (count(*) FILTER (WHERE y = 0))) AS roc_auc FROM ranks GROUP BY model, part),
signal AS (
  SELECT model, greatest(abs(corr(age::DOUBLE, p)), abs(corr(gender_code, p))) AS signal FROM scored WHERE part = 'test' GROUP BY model),
model_rows AS (
  SELECT t.model, t.accuracy, t.precision, t.recall, t.f1, t.rmse, a.accuracy AS train_accuracy, v.accuracy AS validation_accuracy,
         v.log_loss AS validation_log_loss, t.log_loss AS test_log_loss, auc.roc_auc, s.signal AS sensitive_signal_correlation,
         greatest(0, a.accuracy - v.accuracy) AS train_validation_gap,
         (a.accuracy - v.accuracy > 0.10 AND v.accuracy < a.accuracy * 0.92) AS overfitting_flag,
         (a.accuracy < 0.62 AND v.accuracy < 0.62) AS underfitting_flag,
         ((a.accuracy - v.accuracy > 0.10 AND v.accuracy < a.accuracy * 0.92) OR s.signal > 0.65) AS memorization_risk_flag,
         v.accuracy AS cv_accuracy_mean, 0.01::DOUBLE AS cv_accuracy_std
  FROM quality t JOIN quality a ON a.model = t.model AND a.part = 'train' JOIN quality v ON v.model = t.model AND v.part = 'validation'
  JOIN auc ON auc.model = t.model AND auc.part = 'test' JOIN signal s ON s.model = t.model WHERE t.part = 'test')"""
ORACLE["classifier_metrics"] = people_query(
    "SELECT model, part, n::BIGINT AS rows, " + ", ".join(f"{r(c)} AS {c}" for c in ("accuracy", "precision", "recall", "f1", "rmse")) + " FROM quality",
    SPLIT, SCORED,
)
ORACLE["log_loss"] = people_query(f"SELECT model, part, {r('log_loss')} AS log_loss FROM quality", SPLIT, SCORED)
ORACLE["roc_auc_rank"] = people_query(f"SELECT model, part, {r('roc_auc')} AS roc_auc FROM auc", SPLIT, SCORED)
ORACLE["sensitive_signal"] = people_query(
    f"SELECT model, {r('signal')} AS sensitive_signal_correlation FROM signal", SPLIT, SCORED
)
ROW_DOUBLES = (
    "accuracy", "precision", "recall", "f1", "rmse", "train_accuracy", "validation_accuracy", "validation_log_loss",
    "test_log_loss", "roc_auc", "sensitive_signal_correlation", "train_validation_gap", "cv_accuracy_mean", "cv_accuracy_std",
)
ORACLE["model_report_rows"] = people_query(
    "SELECT model, overfitting_flag, underfitting_flag, memorization_risk_flag, " + ", ".join(f"{r(c)} AS {c}" for c in ROW_DOUBLES) + " FROM model_rows",
    SPLIT, SCORED,
)

QUALITY = """quality_terms AS (
  SELECT avg(accuracy) AS masked_accuracy, avg(roc_auc) AS masked_roc_auc,
    greatest(least(1 - (0.45::DOUBLE * least(avg(train_validation_gap) / 0.2::DOUBLE, 1) + 0.20::DOUBLE * least(avg(cv_accuracy_std) / 0.08::DOUBLE, 1)
      + 0.20::DOUBLE * avg(overfitting_flag::INTEGER) + 0.15::DOUBLE * avg(underfitting_flag::INTEGER)), 1), 0) AS generalization_quality,
    max(accuracy) FILTER (WHERE model = 'sharp') AS baseline_accuracy, max(roc_auc) FILTER (WHERE model = 'sharp') AS baseline_roc_auc
  FROM model_rows)"""
RETAINED = """quality_terms AS (SELECT 1::DOUBLE AS masked_accuracy, 1::DOUBLE AS masked_roc_auc, 1::DOUBLE AS generalization_quality,
  1::DOUBLE AS baseline_accuracy, 1::DOUBLE AS baseline_roc_auc)"""
UTILITY = """useful AS (
  SELECT *, greatest(0, baseline_accuracy - masked_accuracy) AS accuracy_drop, greatest(0, baseline_roc_auc - masked_roc_auc) AS roc_auc_drop,
    greatest(least(0.25::DOUBLE * least(masked_accuracy / baseline_accuracy, 1) + 0.15::DOUBLE * least(masked_roc_auc / baseline_roc_auc, 1)
      + 0.18::DOUBLE * correlation_preservation + 0.12::DOUBLE * covariance_preservation + 0.15::DOUBLE * statistical_similarity
      + 0.10::DOUBLE * generalization_quality + 0.05::DOUBLE * (1 - information_loss), 1), 0) AS utility_score
  FROM fidelity CROSS JOIN quality_terms)"""
UTILITY_COLUMNS = (
    "baseline_accuracy", "masked_accuracy", "baseline_roc_auc", "masked_roc_auc", "accuracy_drop", "roc_auc_drop",
    "information_loss", "correlation_preservation", "covariance_preservation", "statistical_similarity",
    "generalization_quality", "utility_score",
)
# Both sections define a CTE named "scored"; the privacy one is renamed where they meet.
PRIVACY_RENAMED = PRIVACY.replace("scored AS (", "private AS (")
OBJECTIVE = f"utility_score - (1 - score) + {WEIGHT * 0.10!r}::DOUBLE * (1 - abs(score - utility_score))"

ORACLE["utility_score"] = trial([NOISE, GENERAL]).query(
    "SELECT config_id, " + ", ".join(f"{r(c)} AS {c}" for c in UTILITY_COLUMNS) + f", {r('1 - utility_score')} AS utility_loss FROM useful",
    *fidelity_parts(), SPLIT, SCORED, QUALITY, UTILITY,
)
ORACLE["objective_score"] = trial([NOISE, GENERAL]).query(
    f"SELECT config_id, round({OBJECTIVE}, 4) AS objective_score FROM useful JOIN private USING (config_id)",
    *fidelity_parts(), SPLIT, SCORED, QUALITY, UTILITY, *class_parts(), DISCLOSURE, PRIVACY_RENAMED,
)

# --- screening sweep over the anchors ------------------------------------------------------------------


def label_cte(configs: Sequence[MaskingConfig]) -> str:
    rows = ", ".join(
        f"({i}, {quoted(c.method)}, {quoted(c.label())}, {d(c.noise_std)}, {c.generalization_bin}, {d(c.epsilon)},"
        f" {d(c.hybrid_dp_budget_fraction)}, {d(c.swap_fraction)}, {d(c.perturbation_strength)})"
        for i, c in enumerate(configs)
    )
    return (
        "settings(config_id, method, config_label, noise_std, generalization_bin, epsilon, hybrid_dp_budget_fraction,"
        f" swap_fraction, perturbation_strength) AS (VALUES {rows})"
    )


RESULTS = f"""results AS (SELECT *, {OBJECTIVE} AS objective_score, score AS privacy_score FROM useful JOIN private USING (config_id) JOIN settings USING (config_id)),
placed AS (SELECT *, row_number() OVER (ORDER BY objective_score DESC, config_id) AS place FROM results)"""


def screened(body: str, configs: Sequence[MaskingConfig] = ANCHORS) -> str:
    return trial(configs).query(
        body, *fidelity_parts(), RETAINED, UTILITY, *class_parts(), DISCLOSURE, PRIVACY_RENAMED, label_cte(configs), RESULTS
    )


THREE = ", ".join(f"{r(c)} AS {c}" for c in ("privacy_score", "utility_score", "objective_score"))
ORACLE["sweep_best"] = screened(f"SELECT config_id, config_label, {THREE} FROM placed WHERE place = 1")
ORACLE["sweep_ranked"] = screened(f"SELECT config_id, method, {THREE} FROM placed")
ORACLE["sweep_candidates"] = screened(f"SELECT config_id, method, {THREE} FROM placed", default_candidates())
ORACLE["report_top_k"] = screened(f"SELECT '#' || place AS rank, method, {THREE} FROM placed WHERE place <= 5")
ORACLE["report_unpivot"] = screened(
    " UNION ALL ".join(
        f"SELECT '#' || place AS rank, method, '{c}' AS metric, {r(c)} AS score FROM placed WHERE place <= 8"
        for c in ("privacy_score", "utility_score", "objective_score")
    )
)
ORACLE["report_tradeoff"] = screened(
    f"SELECT config_id, method, {r('utility_score')} AS utility_score, {r('privacy_score')} AS privacy_score,"
    f" {r('objective_score')} AS objective_score, place = 1 AS best FROM placed"
)
ORACLE["report_summary"] = screened(
    "SELECT method, noise_std, generalization_bin, epsilon, hybrid_dp_budget_fraction, swap_fraction, perturbation_strength,"
    " 'grid_random_genetic' AS optimizer, round(privacy_score, 4) AS privacy_score, round(1 - privacy_score, 4) AS privacy_loss,"
    " round(utility_score, 4) AS utility_score, round(objective_score, 4) AS objective_score, round(k, 4) AS k_anonymity,"
    " round(risk, 4) AS reidentification_risk, round(dis, 4) AS attribute_disclosure_risk, round(leak, 4) AS information_leakage,"
    " 0::DOUBLE AS overfitting_rate, 0::DOUBLE AS underfitting_rate, 0::DOUBLE AS memorization_risk_rate FROM placed WHERE place = 1"
)
# A table with one class, as long as there are people of it.
ORACLE["train_one_class"] = people_query(
    """SELECT v.model, 0::DOUBLE AS accuracy, 0::DOUBLE AS precision, 0::DOUBLE AS recall, 0::DOUBLE AS f1, 1::DOUBLE AS rmse, 0::DOUBLE AS roc_auc,
       0::DOUBLE AS train_accuracy, 0::DOUBLE AS validation_accuracy, 0::DOUBLE AS train_validation_gap, 1::DOUBLE AS validation_log_loss,
       1::DOUBLE AS test_log_loss, 0::DOUBLE AS cv_accuracy_mean, 0::DOUBLE AS cv_accuracy_std, 0::INTEGER AS feature_count,
       false AS overfitting_flag, true AS underfitting_flag, 0::DOUBLE AS sensitive_signal_correlation, false AS memorization_risk_flag,
       '{}' AS best_params
    FROM (VALUES ('Logistic Regression'), ('Random Forest'), ('SVM'), ('XGBoost')) AS v(model)
    WHERE (SELECT count(DISTINCT income) FROM people WHERE income = 1) < 2"""
)

# --- reports -------------------------------------------------------------------------------------------


def comparison(metrics: Sequence[str]) -> str:
    return "compared AS (" + " UNION ALL ".join(
        f"SELECT CASE model WHEN 'sharp' THEN 'Original' ELSE 'Best Masked' END AS dataset, model, '{m}' AS metric, {r(m)} AS score FROM model_rows"
        for m in metrics
    ) + ")"


MODEL_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
ORACLE["report_model_compare"] = people_query("SELECT * FROM compared", SPLIT, SCORED, comparison(MODEL_METRICS))
ORACLE["report_stage_accuracies"] = people_query(
    "SELECT * FROM compared", SPLIT, SCORED,
    comparison(("train_accuracy", "validation_accuracy", "accuracy", "cv_accuracy_mean")),
)
ORACLE["report_mean_scores"] = people_query(
    f"SELECT metric, dataset, {r('avg(score)')} AS score FROM compared GROUP BY metric, dataset",
    SPLIT, SCORED, comparison(MODEL_METRICS),
)
ORACLE["report_loss_by_method"] = trial(default_grid()).query(
    f"""SELECT method, count(*)::BIGINT AS settings, {r("min(information_loss)")} AS lowest,
        {r("quantile_cont(information_loss, 0.25)")} AS lower_quartile, {r("quantile_cont(information_loss, 0.5)")} AS median,
        {r("quantile_cont(information_loss, 0.75)")} AS upper_quartile, {r("max(information_loss)")} AS highest
        FROM loss JOIN settings USING (config_id) GROUP BY method""",
    projected(PEOPLE), LOSS, label_cte(default_grid()),
)
ORACLE["report_drift_metrics"] = trial([GENERAL]).query(
    " UNION ALL ".join(
        f"SELECT feature, '{c}' AS metric, {r(f'coalesce({c}, 0::DOUBLE)')} AS value {DRIFT_JOIN}"
        for c in ("ks_statistic", "kl_divergence", "variance_preservation")
    ),
    *drift_parts(PEOPLE),
)
