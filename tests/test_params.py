import pytest

from wayrisk.functions import params as P


@pytest.mark.parametrize("text,metres", [("500m", 500), ("1km", 1000), ("0.75km", 750), (" 750 ", 750), ("auto", None), ("", None)])
def test_radius_metres(text, metres):
    assert P.radius_metres(text) == metres


@pytest.mark.parametrize("text", ["5 miles", "0m", "-3"])
def test_bad_radius(text):
    with pytest.raises(ValueError):
        P.radius_metres(text)


def test_radii_list_ignores_what_is_no_positive_number():
    assert P.radii_list("500, 250,x,-1,,500") == [250.0, 500.0]
    assert P.radii_list(None) == []


def test_choose_radius():
    assert P.choose_radius([250, 500, 900], "auto") == 900
    assert P.choose_radius([250, 500], "250m") == 250
    assert P.choose_radius([250, 500, 900], 450) == 500
    assert P.choose_radius([250, 900], 450) == 900
    with pytest.raises(ValueError):
        P.choose_radius([250], 450, strict=True)


def test_radii_in_columns():
    cols = ["trips", "crashes_within_250m", "crashes_within_500m_per_100k_trips", "crashes_within_m"]
    assert P.radii_in_columns(cols) == [250, 500]


def test_months_spec():
    assert P.months_spec("1,2,3,10-12") == [1, 2, 3, 10, 11, 12]
    assert P.months_spec("3-1") == [1, 2, 3]
    assert P.months_spec(" ") is None
    with pytest.raises(ValueError):
        P.months_spec("0-2")


def test_request_checks():
    assert P.check_ingest_request([2013, 2030], [1, 12], " NYC ") == "nyc"
    for years, months, mode in ([2012], [1], "jc"), ([2020], [13], "jc"), ([2020], [1], "la"):
        with pytest.raises(ValueError):
            P.check_ingest_request(years, months, mode)


def test_names():
    assert P.standard_name("﻿Start  Station.ID ") == "start_station_id"
    assert P.standard_name("__bike--id__") == "bike_id"
    assert P.crash_name(" NUMBER OF CYCLIST-KILLED/X ") == "number_of_cyclist_killed_x"
    assert P.clean_header(["﻿a", "", "A", "a", None]) == ["a", "col_2", "A__2", "a__3", "col_5"]


def test_pick_column():
    assert P.pick_column(["Latitude", "lat"], ["LATITUDE", "lat"]) == "Latitude"
    assert P.pick_column(["x"], ["lat"]) is None


def test_month_arithmetic():
    assert P.year_month(P.month_index(2023, 12)) == (2023, 12)
    assert P.shift_month(2023, 11, 2) == (2024, 1)
    assert P.shift_month(2023, 1, -1) == (2022, 12)


def test_codec():
    assert P.codec("none") == "uncompressed"
    assert P.codec("ZSTD") == "zstd"
    with pytest.raises(ValueError):
        P.codec("rar")


def test_int_list():
    assert P.int_list("2023 2024, 2025") == [2023, 2024, 2025]
    assert P.int_list("") is None
