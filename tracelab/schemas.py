"""Schemas of the tables that the library reads and writes. Times are milliseconds unless a column says otherwise."""

from __future__ import annotations

RAW_MACHINE_META = "machine_id string, time_stamp bigint, failure_domain_1 string, failure_domain_2 string, cpu_num int, mem_size double, status string"
RAW_CONTAINER_META = "container_id string, machine_id string, time_stamp bigint, app_du string, status string, cpu_request int, cpu_limit int, mem_size double"
RAW_BATCH_TASK = "task_name string, instance_num bigint, job_name string, task_type string, status string, start_time bigint, end_time bigint, plan_cpu double, plan_mem double"
CLEAN_MACHINES = "machine string, cpu int, mem double, failure_d_1 string, failure_d_2 string, available boolean, time bigint"
CLEAN_JOBS = "job string, type string, submit bigint, duration bigint, task_group string, instances bigint, mem double, cpu double, connections string"

#: Columns of the statistics files, as their writers name them.
STATS = {
    "scheduler": "Time bigint, PastSystemMs bigint, Attempts bigint, Allocations bigint, ScheduledTasks bigint, ThinkTime bigint, ThinkTimeWasted bigint, JobsInQueue bigint, TotalJobsFullyScheduled bigint, TotalJobsFullyScheduledINP bigint, TotalJobQueueTime bigint, CountJobs bigint, CountJobsWithInp bigint, CountJobsFinished bigint, CountJobsFinishedINP bigint, CountPreemptions bigint, PendingSchedulingItems bigint, PendingJobsNotFullyScheduled bigint, PendingJobsFullyScheduled bigint, PendingJobsNotFullyScheduledPlusFutureTgSubmissions bigint, TimesServerFallbackResubmit bigint, TimesServerFlavorTaken bigint, TimesSwitchFlavorTaken bigint, BacklogSize bigint",
    "cell": "Time bigint, UtilizationSwitchINP double, UtilizationSwitchesDim0 double, UtilizationSwitchesDim1 double, UtilizationSwitchesDim2 double, ActualUtilizationSwitchesDim0 double, ActualUtilizationSwitchesDim1 double, ActualUtilizationSwitchesDim2 double, UtilizationServersDim0 double, UtilizationServersDim1 double",
    "taskgroups": "JobID bigint, JobStatus string, FlavorInp string, ValidForJob string, TaskGroupID bigint, SubmissionTime bigint, TotalTasks bigint, TaskGroupType string, TasksStarted bigint, AvgQueueing double, PlacementLatency bigint, Duration bigint, OriginalDuration bigint, DetourInc double, InvolvedRacks double, MaxDiameter double",
    "jobs": "JobID bigint, JobStatus string, InvolvedTGCnt bigint, TasksTotal bigint, TasksStarted bigint, AvgTaskQueueing double, AvgTaskDuration double, AvgTaskDurationOriginal double, InpStatus string",
    "solver": "RunID bigint, Solver string, ParallelRun boolean, SimulationTime bigint, StartTimeNanos bigint, EndTimeNanos bigint, ProducerCnt bigint, NonProducerCnt bigint, Supply bigint, ServerLoad double, SwitchLoad double, CleanUpTime bigint",
    "timings": "SimulationTime bigint, CleanupTime bigint, SolverTime bigint, TotalTime bigint, InterpretTime bigint",
}


def cell_inp(properties=range(2, 10), dims: int = 3) -> str:
    """The load table's columns, for the given property ids."""
    names = [f"{kind}Switch_Prop{p}_Dim{d} double" for p in properties for d in range(dims) for kind in ("Utilization", "Reserved", "Total", "BlockedByOthers")]
    return ", ".join(["Time bigint", *names])
