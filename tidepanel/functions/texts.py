"""Wording and word lists of the results.

These are fixed values: result tables carry these texts, so they have to be the same everywhere.
"""

from __future__ import annotations

# --- fixed values: names that mark a label column -------------------------------------------
LABEL_NAMES = [
    "label", "labels", "anomaly", "anomalies", "is_anomaly", "target", "y", "ground_truth",
    "fault", "outlier", "이상", "이상여부", "라벨",
]

# --- fixed values: words that mark a time column --------------------------------------------
TIME_WORDS = ["time", "date", "timestamp", "datetime", "ds", "일시", "날짜", "시간"]

# --- fixed values: cell texts read as missing -----------------------------------------------
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: scorers -------------------------------------------------------------------
SCORER_LABELS = {
    "norm": "NormScorer (예측오차 크기)",
    "kmeans": "KMeansScorer (패턴 군집)",
    "wasserstein": "WassersteinScorer (분포 변화)",
}

# --- fixed values: fill methods --------------------------------------------------------------
FILL_LABELS = {
    "interpolate_linear": "선형 보간 (Interpolation)",
    "ffill": "직전값 유지 (LOCF)",
    "bfill": "직후값 유지 (NOCB)",
    "moving_average": "이동평균 기반 대체",
}
FILL_LABEL_NONE = "없음 (결측치 없음)"

# --- fixed values: duration ------------------------------------------------------------------
DURATION_YEARS = "약 %.1f년 (%s일)"
DURATION_DAYS = "%s일"
DURATION_HOURS = "약 %.1f시간"

# --- fixed values: explanations --------------------------------------------------------------
DIRECTION_UP = "최근 패턴 대비 급격한 상승"
DIRECTION_DOWN = "최근 패턴 대비 급격한 하강"
CONFIDENCE_HIGH = "이상 가능성 높음 (다중 지표 동시 탐지)"
CONFIDENCE_MEDIUM = "이상 가능성 보통 (단일 지표 탐지)"
CONFIDENCE_REFERENCE = "참고용 (점수는 높지만 임계값 미달)"
LINE_VARIABLE = "변수: %s"
LINE_SIGMA = "평균 대비 %+.1fσ (시그마)"
LINE_CHANGE = "직전 구간 대비 %+.1f%% 변화"
LINE_DETECTED_MANY = "%s 동시 탐지"
LINE_DETECTED_ONE = "%s 탐지"
LINE_CONFIDENCE = "→ %s"

# --- fixed values: stationarity --------------------------------------------------------------
STATIONARY_YES = (
    "정상성 시계열로 판정됩니다 (평균/분산이 시간에 따라 일정). "
    "차분 없이 통계 모형을 적용할 수 있습니다."
)
STATIONARY_NO = (
    "비정상성 시계열로 판정됩니다 (추세 또는 분산 변화 존재). "
    "차분(differencing) 등으로 정상화 후 분석을 권장합니다."
)
AUTOCORRELATED_YES = " 시차 간 자기상관이 존재해 예측 가능한 패턴이 있는 것으로 보입니다."
AUTOCORRELATED_NO = " 백색잡음에 가까워 추가 패턴을 찾기 어려울 수 있습니다."
