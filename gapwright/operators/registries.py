"""Registries: covariate arms, methods, evidence of artifacts. Constants on the driver, and small tables for joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .covariates import forbidden

# --- covariate arms ---------------------------------------------------------------------------------------

#: Columns of each covariate family (fixed values).
FAMILIES: dict[str, list[str]] = {
    "proxy": "chl_cons_w3x3_mean chl_anom_log10_doy".split(),
    "solar": "plv_solar_wm2 plv_solar_roll3d_wm2 plv_solar_roll7d_wm2 plv_solar_roll14d_wm2 plv_solar_roll21d_wm2 plv_solar_lag3d_wm2 plv_solar_lag7d_wm2".split(),
    "wind_upwelling": """plv_wind_u_ms plv_wind_v_ms plv_wind_spd_ms wind_u_ms wind_v_ms wind_spd_ms wind_u_ms_lag1 wind_u_ms_lag3 wind_u_ms_lag7 wind_u_ms_roll3 wind_u_ms_roll7
        wind_v_ms_lag1 wind_v_ms_lag3 wind_v_ms_lag7 wind_v_ms_roll3 wind_v_ms_roll7 wind_spd_ms_lag1 wind_spd_ms_lag3 wind_spd_ms_lag7
        plv_upwelling_ms plv_upwelling_cumul3d_ms_d plv_upwelling_cumul7d_ms_d plv_upwelling_cumul14d_ms_d plv_upwelling_cumul21d_ms_d
        cmems_upwelling_ms cmems_upwelling_cumul3d_ms_d cmems_upwelling_cumul7d_ms_d cmems_upwelling_cumul14d_ms_d cmems_upwelling_cumul21d_ms_d
        plv_relaxation_index_14p3r cmems_relaxation_index_14p3r plv_dir_persist_7d""".split(),
    "thermal": """sst_primary_degC sst_primary_degC_lag1 sst_primary_degC_lag3 sst_primary_degC_lag7 sst_primary_degC_roll3 sst_primary_degC_roll7
        mur_sst_degC mur_sst_nearest_degC mur_sst_10km_mean_degC mur_sst_10km_std_degC mur_gradient_10km_max_degC_per_km mur_gradient_10km_mean_degC_per_km
        mur_gradient_25km_max_degC_per_km mur_front_dist_km mur_coastal_grad_340_degC mur_coastal_grad_local_degC mur_sst_anom_doy_degC mur_sst_anom_monthly_degC
        mur_sst_cooling_1d_degC mur_sst_cooling_3d_degC mur_sst_cooling_7d_degC mur_sst_cooling_14d_degC mur_sst_cooling_21d_degC
        mur_sst_roll3d_degC mur_sst_roll7d_degC mur_sst_roll14d_degC mur_sst_roll21d_degC mur_front_persist_7d mur_front_persist_14d ostia_sst_degC""".split(),
    "meteorological": """plv_pressure_hPa plv_pressure_roll3d_hPa plv_pressure_roll7d_hPa plv_pressure_roll14d_hPa plv_pressure_lag3d_hPa plv_pressure_lag7d_hPa
        plv_humid_pct plv_humid_roll7d_pct plv_humid_roll14d_pct plv_precip_daily_mm plv_precip_roll7d_mm plv_temp_degC""".split(),
    "currents": """glorys_uo_surface_ms glorys_vo_surface_ms glorys_speed_surface_ms glorys_alongshore_340_ms glorys_crossshore_340_ms glorys_alongshore_053_ms glorys_crossshore_053_ms
        glorys_mld_m glorys_thetao_surface_degC glorys_speed_roll3 glorys_speed_roll7 glorys_speed_roll14 glorys_speed_roll21
        glorys_weak_current_frac3 glorys_weak_current_frac7 glorys_weak_current_frac14 glorys_weak_current_frac21
        glorys_cumul_along340_3d glorys_cumul_cross340_3d glorys_cumul_along340_7d glorys_cumul_cross340_7d glorys_cumul_along340_14d glorys_cumul_cross340_14d
        glorys_cumul_along340_21d glorys_cumul_cross340_21d glorys_sign_persist_along340_7d glorys_sign_persist_cross340_7d glorys_sign_persist_along340_14d glorys_sign_persist_cross340_14d
        glorys_reversal_count_along340_7d glorys_reversal_count_along340_14d glorys_reversal_count_along340_21d glorys_mld_roll7
        glorys_u_mean_3x3 glorys_v_mean_3x3 glorys_speed_mean_3x3 glorys_divergence_s_per_km glorys_vorticity_s_per_km glorys_okubo_weiss_heuristic
        multiobs_ugos_ms multiobs_vgos_ms multiobs_ue_ms multiobs_ve_ms multiobs_geos_speed_ms multiobs_ekman_speed_ms
        multiobs_component_sum_u_ms multiobs_component_sum_v_ms multiobs_component_sum_speed_ms multiobs_along340_geos_ms multiobs_cross340_geos_ms
        multiobs_along340_ekman_ms multiobs_cross340_ekman_ms multiobs_ekman_geo_ratio""".split(),
    "availability": """mur_sst_available ostia_sst_available chl_cons_available chl_perm_available wind_available plv_wind_valid_hours plv_wind_coverage
        plv_temp_valid_hours plv_pressure_valid_hours mur_mask_rescued chl_is_gapfree multiobs_availability_flag multiobs_source_flag""".split(),
    "curated": "plv_solar_roll7d_wm2 plv_upwelling_cumul7d_ms_d wind_spd_ms sst_primary_degC_roll7 mur_sst_cooling_7d_degC plv_pressure_hPa plv_relaxation_index_14p3r".split(),
    "solar_x_upwelling": "plv_solar_wm2 plv_solar_roll7d_wm2 plv_upwelling_ms plv_upwelling_cumul7d_ms_d solar_x_upwelling_product".split(),
    "upwelling_x_cooling": "plv_upwelling_ms plv_upwelling_cumul7d_ms_d mur_sst_cooling_7d_degC sst_primary_degC_roll7 upwelling_x_cooling_product".split(),
    "calendar": "doy_sin doy_cos".split(),
    "forcing": "plv_solar_wm2 plv_solar_roll7d_wm2 plv_upwelling_ms plv_upwelling_cumul7d_ms_d sst_primary_degC sst_primary_degC_roll7 wind_spd_ms".split(),
    "near_currents": "glorys_speed_surface_ms glorys_alongshore_340_ms glorys_crossshore_340_ms glorys_speed_roll7 multiobs_geos_speed_ms multiobs_ekman_speed_ms".split(),
    "station": "btg_water_temp_daily_mean btg_pressure_daily_mean".split(),
    "surface": "sst_primary_degC sst_primary_degC_roll7".split(),
    "upwelling": "plv_upwelling_ms plv_upwelling_cumul7d_ms_d wind_spd_ms".split(),
    "radiation": "plv_solar_wm2 plv_solar_roll7d_wm2".split(),
}

#: Arm to (role, families) (fixed values).
ARMS: dict[str, tuple[str, tuple[str, ...]]] = {
    "target_only": ("primary", ()),
    "satellite_proxy": ("primary", ("proxy",)),
    "solar_only": ("supporting", ("solar",)),
    "wind_upwelling_only": ("supporting", ("wind_upwelling",)),
    "sst_thermal_only": ("supporting", ("thermal",)),
    "plv_meteorological": ("supporting", ("meteorological",)),
    "current_transport_only": ("supporting", ("currents",)),
    "availability_proxy_only": ("supporting", ("availability",)),
    "solar_upwelling_interaction": ("supporting", ("solar_x_upwelling",)),
    "upwelling_cooling_interaction": ("supporting", ("upwelling_x_cooling",)),
    "curated_physical": ("primary", ("curated",)),
    "full_physical_redundant": ("supporting", ("solar", "wind_upwelling", "thermal", "meteorological")),
    "proxy_plus_solar": ("supporting", ("proxy", "solar")),
    "proxy_plus_wind_upwelling": ("supporting", ("proxy", "wind_upwelling")),
    "proxy_plus_sst": ("supporting", ("proxy", "thermal")),
    "proxy_plus_plv_met": ("supporting", ("proxy", "meteorological")),
    "proxy_plus_current_transport": ("supporting", ("proxy", "currents")),
    "proxy_plus_availability": ("supporting", ("proxy", "availability")),
}
#: Arm to (families, placebo) of the primary grid, in its order (fixed values).
PRIMARY: dict[str, tuple[tuple[str, ...], str]] = {
    "target_only": ((), "none"),
    "target_plus_calendar": (("calendar",), "none"),
    "target_plus_physical_forcing": (("forcing",), "none"),
    "satellite_proxy": (("proxy",), "none"),
    "target_plus_physical_forcing_plus_proxy": (("forcing", "proxy"), "none"),
    "wrong_lag_physical_forcing": (("forcing",), "wrong_lag"),
}
#: Arms of the raw-scale target: (tier, families) (fixed values).
RAW_ARMS: dict[str, tuple[str, tuple[str, ...]]] = {
    "target_only": ("audited", ()),
    "calendar_seasonal": ("audited", ("calendar",)),
    "external_physical_core": ("audited", ("forcing",)),
    "external_physical_plus_currents": ("audited", ("forcing", "near_currents")),
    "local_btg_temp_pressure_diagnostic": ("audited", ("station",)),
    "currents_only": ("ablation", ("near_currents",)),
    "sst_thermal_only": ("ablation", ("surface",)),
    "wind_upwelling_only": ("ablation", ("upwelling",)),
    "radiation_only": ("ablation", ("radiation",)),
}
#: Substrings that no covariate of the raw-scale target may hold, and diagnostic arms (fixed values).
FORBIDDEN = ("chl_mean", "chl_cons", "chl_perm", "chl_anom", "chl_log10", "chl_is_gapfree", "BTGOXD", "BTGOXSATPC", "BTGSAL", "BTGTUR", "BTGCND")
DIAGNOSTIC = ("external_all_available", "local_btg_temp_pressure_diagnostic")
#: Placebos, and the arms that they are made of (fixed values).
PLACEBOS = ("wrong_lag", "season_shuffled", "year_shifted", "permuted")
PLACEBO_ARMS = ("curated_physical", "wind_upwelling_only", "solar_only", "sst_thermal_only", "current_transport_only", "availability_proxy_only")


def columns(families: tuple[str, ...]) -> list[str]:
    return [c for f in families for c in FAMILIES[f]]


def is_diagnostic(arm: str) -> bool:
    return arm in DIAGNOSTIC


def check_arms(arms: dict[str, tuple[str, tuple[str, ...]]]) -> None:
    """Raises if an arm holds a forbidden covariate."""
    for name, (_, families) in arms.items():
        if bad := forbidden(columns(families), parts=FORBIDDEN):
            raise ValueError(f"forbidden covariates in {name!r}: {bad}")


check_arms(RAW_ARMS)


def arms(spark: SparkSession) -> DataFrame:
    """(arm, role, n_columns, extended, placebo_eligible): extended arms need the columns of the extension table."""
    rows = [(a, role, len(columns(f)), "currents" in f, a in PLACEBO_ARMS) for a, (role, f) in ARMS.items()]
    return spark.createDataFrame(rows, "arm string, role string, n_columns int, extended boolean, placebo_eligible boolean")


def arm_members(spark: SparkSession, which: dict | None = None) -> DataFrame:
    """(arm, place, column) of every arm's columns in order."""
    which = ARMS if which is None else which
    return spark.createDataFrame([(a, k, c) for a, (_, f) in which.items() for k, c in enumerate(columns(f))], "arm string, place int, column string")


def primary_grid(pool: DataFrame, modes: tuple[str, ...] = ("full_series", "edge_balanced")) -> DataFrame:
    """Every call of the primary grid: gaps x context modes x arms, with the arm's placebo and number of covariates."""
    cells = [(m, a, t, len(columns(f)), k) for m in modes for k, (a, (f, t)) in enumerate(PRIMARY.items())]
    grid = pool.sparkSession.createDataFrame(cells, "context_mode string, arm string, transform string, n_columns int, arm_order int")
    return pool.select("gap_id", "gap_length").crossJoin(F.broadcast(grid)).withColumn("key", F.concat_ws("|", "gap_id", "context_mode", "arm"))


# --- methods and evidence ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Method:
    method_id: str
    public_name: str
    role: str
    support_status: str
    learner: str | None = None


#: Methods of the benchmark (fixed values: identifiers, labels and statuses).
METHODS = (
    Method("canonical_interpolation", "Linear interpolation", "classical_benchmark", "frozen_matched_449"),
    Method("gp_m1", "Gaussian process", "classical_benchmark", "frozen_matched_449", "gaussian_process"),
    Method("ext_tabular_extratrees", "External tabular (ExtraTrees)", "classical_benchmark", "frozen_matched_449", "extra_trees"),
    Method("ext_tabular_hgb", "External tabular (HGB)", "classical_benchmark", "frozen_matched_449", "hist_boosted"),
    Method("external_only_extratrees", "External tabular, plain external-only protocol (ExtraTrees)", "classical_benchmark", "new_evaluation_on_matched_449", "extra_trees"),
    Method("external_only_hgb", "External tabular, plain external-only protocol (HGB)", "classical_benchmark", "new_evaluation_on_matched_449", "hist_boosted"),
    Method("tier_ch_deployed", "Gap-edge residual model", "classical_benchmark", "frozen_matched_449", "extra_trees"),
    Method("engineered_hybrid", "Engineered hybrid pipeline (validation-aware method assignment)", "classical_benchmark", "new_evaluation_on_matched_449"),
    Method("sequence_target_only", "Sequence model target-only", "external_reference", "frozen_matched_449"),
    Method("sequence_satellite_proxy", "Sequence model satellite-proxy", "external_reference", "frozen_matched_449"),
)
#: Artifacts of real gaps: (name, gaps, scale, is it a candidate and never an observation, role) (fixed values).
ARTIFACTS = (
    ("real_gap_inventory", 128, "n/a", False, "observed_real_missing_interval"),
    ("engineered_hybrid_reconstruction", 128, "physical_mg_m3", True, "method_selected_candidate"),
    ("sequence_satellite_proxy_reconstruction", 128, "both", True, "reconstruction_candidate"),
    ("candidate_outputs_gap_level", 128, "physical_mg_m3", True, "reconstruction_candidate"),
    ("candidate_outputs_daily", None, "physical_mg_m3", True, "reconstruction_candidate"),
)
#: What a value can be (fixed values).
EVIDENCE = (
    "artificial_validation_gap", "observed_real_missing_interval", "reconstruction_candidate", "method_selected_candidate", "scenario_only",
    "frozen_published_result", "executable_deterministic_assembly", "expensive_model_generation_not_rerun",
)
#: Statuses of the raw-scale target's methods; it has no reconstruction candidates (fixed values).
STATUSES = ("frozen_primary_benchmark", "frozen_exploratory_extended", "executable_bounded_validation", "exploratory_ablation", "same_station_diagnostic", "new_consistency_evaluation")
RAW_CANDIDATES_EXIST = False


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.method_id, m.public_name, m.role, m.support_status, m.learner) for m in METHODS], "method_id string, public_name string, role string, support_status string, learner string")


def artifacts(spark: SparkSession) -> DataFrame:
    if unknown := {a[4] for a in ARTIFACTS} - set(EVIDENCE):
        raise ValueError(f"unknown roles: {unknown}")
    return spark.createDataFrame(ARTIFACTS, "artifact string, n_gaps int, scale string, is_candidate boolean, role string")


def status_of(tier: str, gap_length: Column, arm: str | None = None) -> Column:
    """Status of a raw-scale result: by the arm's tier, and for frozen ones by the gap's length."""
    if arm is not None and is_diagnostic(arm):
        return F.lit("same_station_diagnostic")
    if tier == "ablation":
        return F.lit("exploratory_ablation")
    if tier != "audited":
        raise ValueError(f"unknown tier {tier!r}")
    return F.when(gap_length <= 30, "frozen_primary_benchmark").otherwise("frozen_exploratory_extended")
