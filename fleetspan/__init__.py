"""fleetspan: transit headway analytics and corpus preparation on Spark DataFrames."""
