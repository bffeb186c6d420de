"""A small airline: three days, a recurring flight number, and every kind of gap in the data."""

from datetime import date, datetime, timedelta

from skyload.sources.tables import Inputs

FLIGHTS = (
    "company_id string, flight_number bigint, scheduled_departure_date_local date, scheduled_departure_station_code string, "
    "scheduled_arrival_station_code string, scheduled_departure_datetime_local timestamp_ntz, scheduled_arrival_datetime_local timestamp_ntz, "
    "actual_departure_datetime_local timestamp_ntz, total_seats int, fleet_type string, carrier string, scheduled_ground_time_minutes int, "
    "actual_ground_time_minutes int, minimum_turn_minutes int"
)
BAGS = (
    "company_id string, flight_number bigint, scheduled_departure_date_local date, bag_tag_unique_number string, "
    "bag_tag_issue_date timestamp_ntz, bag_type string"
)
BOOKINGS = (
    "company_id string, flight_number bigint, scheduled_departure_date_local date, record_locator string, pnr_creation_date timestamp_ntz, "
    "total_pax int, lap_child_count int, is_child string, basic_economy_pax int, is_stroller_user string"
)
REMARKS = "record_locator string, pnr_creation_date timestamp_ntz, flight_number string, special_service_request string"


def flight_row(company, number, day, origin="ORD", to="MIA", hour=8, minute=15, seats=180, ground=55, actual=54, least=50, late=4):
    start = datetime(day.year, day.month, day.day, hour, minute)
    return (
        company, number, day, origin, to, start, start + timedelta(minutes=200), start + timedelta(minutes=late), seats,
        "738", "Mainline", ground, actual, least,
    )


def airline(spark, days=12, numbers=8):
    """Generated inputs with the full column layout."""
    first = date(2025, 8, 1)
    stations = ["MIA", "LHR", "SFO", "CDG"]
    flights, bags, bookings, remarks = [], [], [], []
    for d in range(days):
        day = first + timedelta(days=d)
        for n in range(numbers):
            number = 1000 + n
            seed = (d * 31 + n * 17) % 97
            flights.append(
                flight_row("UA", number, day, to=stations[(n + d) % 4], hour=6 + n % 5, seats=100 + 20 * n, ground=30 + seed % 40,
                           actual=25 + seed % 50, least=45, late=seed % 60 - 10)
            )
            for b in range(seed % 9):
                kind = ["Origin", "Transfer", "Hot Transfer", "Checked", "Crew"][b % 5]
                issued = datetime(day.year, day.month, day.day, 4) + timedelta(minutes=37 * b)
                bags.append(("UA", number, day, f"T{d}-{n}-{b}", issued, kind))
            for p in range(seed % 7):
                locator = f"L{(d * numbers + n * 3 + p) % 60}"
                made = datetime(day.year, day.month, day.day, 10) - timedelta(days=1 + p * 3)
                bookings.append(("UA", number, day, locator, made, 1 + p, p % 2, "Y" if p % 3 == 0 else "N", p, "Y" if p == 2 else "N"))
    for r in range(40):
        text = ["WCHR to gate", "carpet sample", "vegan meal", None, "unaccompanied UMNR"][r % 5]
        remarks.append((f"L{r % 60}", None, str(1000 + r % numbers), text))
    return Inputs(
        flights=spark.createDataFrame(flights, FLIGHTS),
        bags=spark.createDataFrame(bags, BAGS),
        bookings=spark.createDataFrame(bookings, BOOKINGS),
        remarks=spark.createDataFrame(remarks, REMARKS),
        airports=spark.createDataFrame(
            [("MIA", "US"), ("LHR", "GB"), ("SFO", "US"), ("SFO", "US")], "airport_iata_code string, iso_country_code string"
        ),
    )


def rounded(df, columns=None):
    """Rows with doubles at nine digits, in a fixed order; sums may differ in their last bits."""
    table = df.select(*(columns or sorted(df.columns)))
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in table.collect()), key=str)
