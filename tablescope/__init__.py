"""tablescope: profile, repair and analyse flat business tables with Spark DataFrames."""
