"""``Column -> Column`` helpers; no function here starts a job."""
