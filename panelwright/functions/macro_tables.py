"""Published policy rate, inflation and growth tables."""

REPO_RATE = {
    "2022-01": 4.00, "2022-02": 4.00, "2022-03": 4.00, "2022-04": 4.00, "2022-05": 4.40, "2022-06": 4.90,
    "2022-07": 4.90, "2022-08": 5.40, "2022-09": 5.40, "2022-10": 5.90, "2022-11": 5.90, "2022-12": 6.25,
    "2023-01": 6.25, "2023-02": 6.50, "2023-03": 6.50, "2023-04": 6.50, "2023-05": 6.50, "2023-06": 6.50,
    "2023-07": 6.50, "2023-08": 6.50, "2023-09": 6.50, "2023-10": 6.50, "2023-11": 6.50, "2023-12": 6.50,
    "2024-01": 6.50, "2024-02": 6.50, "2024-03": 6.50, "2024-04": 6.50, "2024-05": 6.50, "2024-06": 6.50,
    "2024-07": 6.50, "2024-08": 6.50, "2024-09": 6.50, "2024-10": 6.50, "2024-11": 6.50, "2024-12": 6.50,
    "2025-01": 6.50, "2025-02": 6.25, "2025-03": 6.25, "2025-04": 6.00, "2025-05": 6.00, "2025-06": 6.00,
    "2025-07": 6.00, "2025-08": 6.00, "2025-09": 6.00, "2025-10": 6.00,
}

CPI_INFLATION = {
    "2022-01": 6.01, "2022-02": 6.07, "2022-03": 6.95, "2022-04": 7.79, "2022-05": 7.04, "2022-06": 7.01,
    "2022-07": 6.71, "2022-08": 7.00, "2022-09": 7.41, "2022-10": 6.77, "2022-11": 5.88, "2022-12": 5.72,
    "2023-01": 6.52, "2023-02": 6.44, "2023-03": 5.66, "2023-04": 4.70, "2023-05": 4.25, "2023-06": 4.81,
    "2023-07": 7.44, "2023-08": 6.83, "2023-09": 5.02, "2023-10": 4.87, "2023-11": 5.55, "2023-12": 5.69,
    "2024-01": 5.10, "2024-02": 5.09, "2024-03": 4.85, "2024-04": 4.83, "2024-05": 4.75, "2024-06": 5.08,
    "2024-07": 3.54, "2024-08": 3.65, "2024-09": 5.49, "2024-10": 6.21, "2024-11": 5.48, "2024-12": 5.22,
    "2025-01": 4.31, "2025-02": 3.61, "2025-03": 3.34, "2025-04": 3.16, "2025-05": 4.00, "2025-06": 4.00,
    "2025-07": 4.00, "2025-08": 4.00, "2025-09": 4.00, "2025-10": 4.00,
}

GDP_GROWTH = {
    "Q1-2022": 13.1, "Q2-2022": 6.2, "Q3-2022": 4.5, "Q4-2022": 6.1,
    "Q1-2023": 7.8, "Q2-2023": 7.6, "Q3-2023": 8.4, "Q4-2023": 7.8,
    "Q1-2024": 6.7, "Q2-2024": 5.4, "Q3-2024": 6.2, "Q4-2024": 6.2,
    "Q1-2025": 6.3, "Q2-2025": 6.5, "Q3-2025": 6.5, "Q4-2025": 6.5,
}
