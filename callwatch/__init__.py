"""callwatch: marine-radio call analytics and corpus preparation as Spark jobs."""
